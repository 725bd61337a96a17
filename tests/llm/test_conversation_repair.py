"""Conversation repair against a plain dynamic program over whole rows."""

import collections
import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\f\r"


def _best(initials, faults):
    """Least (cost, audit) by rows: initials and faults ('', 'truncated' or 'forced')."""

    def follow(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(initials) and state in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            to = "a" if state == "u" else "u"
            cost, audit = best(i, to, inserted + 1)
            found.append((cost + 2, "I" + audit))
        if i < len(initials):
            steps = [("D", 3, state)]
            if faults[i] != "forced":
                worse = faults[i] == "truncated"
                steps.append(("R", 2 + worse, "a" if state == "u" else "u"))
                if follow(state, initials[i]):
                    steps.append(("K", worse, follow(state, initials[i])))
            for edit, cost, to in steps:
                more, audit = best(i + 1, to, 0)
                found.append((cost + more, edit + audit))
        return min(found, default=(10**9, ""))

    for i in range(len(initials), -1, -1):  # from the back, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    return best(0, "", 0)


def _damaged(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        out[conv]
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def _brute(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if text.strip(WHITE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = _best(tuple(initials), tuple("forced" if f in ("blank", "duplicate") else f for f in faults))
    out, at = [], 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit == "D":
            continue
        out.append((role if edit == "K" else "assistant" if out and out[-1][0][:1] == "u" else "user", text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), out


def _rows(seed, conversations=120):
    rng = np.random.default_rng(seed)
    pool = ["One. Two!", "no end", "Is it?", " \t\n", "", "Yes.", "same text.", "x" * 3000 + ".", "é中𝄞!", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"]
    out = []
    for conv in range(conversations):
        for turn in range(int(rng.integers(1, 14))):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            text = f"Turn {turn} of {conv}." if rng.random() < 0.5 else pool[rng.integers(len(pool))]
            out.append((conv, int(turn + 3 * (rng.random() < 0.2)) if rng.random() < 0.95 else None, role, text))
    out += [(None, 0, "user", "No id."), (None, None, "assistant", "No turn."), (-5, -(2**62), "user", "Far."), (-5, 2**62, "assistant", "Away.")]
    out += [(7000, 1, "user", "again and again.")] * 300 + [(7001, k, "user", "the same first.") for k in range(200)]
    out += [(7002, k, ["user", "assistant"][k % 2], f"Long {k}.") for k in range(600)] + [(7003, k, "assistant", f"open {k}") for k in range(150)]
    return out + out[:20]


@pytest.mark.parametrize("seed, piece, partitions", [(1, 1 << 14, 4), (2, 5, 3), (3, 1, 7), (4, 64, 1)])
def test_repair_equals_brute_force(spark, seed, piece, partitions):
    rows = _rows(seed)
    want, told = {}, {}
    for conv, own in _damaged(rows).items():
        want[conv], told[conv] = _brute(conv, own)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("copies", "digest", "kind", "seq", "whole", "n", "first", "blank")})
        got = cr.repair(cr.damage(frame), piece_rows=piece).collect()
        short = cr.repair(cr.damage(frame), with_turns=False, piece_rows=piece).where("last").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert {r.conv_id: (r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got if r.last} == want
    assert short == len(want) == sum(r.last for r in got)
    rebuilt, edits = collections.defaultdict(list), collections.defaultdict(str)
    for r in sorted(got, key=lambda r: r.chunk):
        rebuilt[r.conv_id] += [(t.role, t.text) for t in r.turns]
        edits[r.conv_id] += r.edits
    assert {c: rebuilt[c] for c in told} == told
    assert edits == {c: w[7] for c, w in want.items()}


def test_odd_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert cr.repair(cr.damage(none)).count() == 0
    gone = [(c, t, "user", "Text.") for c in range(50) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = cr.repair(cr.damage(spark.createDataFrame(gone, ROWS))).collect()
    assert {r.conv_id for r in got} == {g[0] for g in gone}
    assert {(r.gaps, r.blank, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == {(0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


RUNS = st.lists(st.tuples(st.integers(0, 8), st.integers(1, 40)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(RUNS)
def test_runs_equal_single_rows(runs):
    names = {0: ("s", ""), 1: ("s", "truncated"), 2: ("u", ""), 3: ("u", "truncated"), 4: ("a", ""), 5: ("a", "truncated"), 6: ("x", ""), 7: ("x", "truncated"), 8: ("u", "forced")}
    flat = [names[s] for s, n in runs for _ in range(n)]
    assert cr.solved(tuple(runs)) == _best(tuple(f[0] for f in flat), tuple(f[1] for f in flat))
    vector = (0, 4, 2, 0)
    step = vector
    for s, n in reversed(runs):
        vector = cr.advance(s, n, vector)
        for _ in range(n):
            step = cr.applied(cr.power(s, 0), step)
    assert vector == step == cr.applied(cr.product(tuple(runs)), (0, 4, 2, 0)) if runs else True

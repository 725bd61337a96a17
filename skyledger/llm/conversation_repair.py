"""Repair of damaged conversations at least cost, by a run-length min-plus DP.

A conversation's rows stand in the order of turn (nulls first), then role, then
the SHA-256 of the text. A row is blank (no character outside ASCII white
space), a duplicate (role and text seen earlier in the conversation) or
truncated (its last character outside white space is none of ``.!?``); the
first that holds counts. The repaired roles begin with s, u, a in the form
``(s?(ua)+)?``. Keep costs 0, rerole to user or assistant 2, delete 3 (forced
for blank rows and duplicates), insert an empty user or assistant row 2; a
truncated row that stays costs 1 more. The audit is the initials of the edits
(D, I, K, R), the least in ASCII order among the cheapest.

Method. What has been put out so far is one of four states (nothing, s, u, a),
so a row is a 4 x 4 min-plus matrix: which role initial and fault it has decides
it. Equal consecutive symbols are collapsed into runs; a run of n rows moves the
vector of costs-to-go by the binary powers of its matrix, which are cached.
From the costs-to-go the edits are unrolled forward: a row's edits depend on its
symbol, the state and the shape of the costs after it, which soon repeats.

Scale. Identical rows become one row with a count ahead of everything else, so
copies cost one row. The rows are range-partitioned by conversation, turn, role
and digest, so a conversation of any size is spread over as many partitions as
its rows fill; duplicates are marked by the first place of each (conversation,
role, digest), which is an aggregate. Conversations inside one partition are
finished there. Of the others (two for each partition boundary at most, or a
huge one) the pieces of bounded size are written with their matrix
product: a fold over those small matrices from the back gives each piece its
costs-to-go, the pieces are unrolled side by side from all four states, and a
fold from the front picks the state and feeds the digest. Only that last fold
sees a conversation in one task, as a stream, since a SHA-256 cannot be joined
from parts.

Null conversation ids are a conversation; a null role or text is one space; a
conversation without rows (``copies`` 0) has zeros and empty texts; an empty
table gives no rows; further columns are ignored, whatever their names. Gaps
beyond 2^63 - 1 are given as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import store, tokens

_WHITE = " \t\n\x0b\f\r"
_CHUNK_BYTES = 4 << 20

NOTHING, S, U, A = range(4)  # what the repaired conversation ends with so far
STATES = range(4)
NEXT = (U, U, A, U)  # the state after a user or assistant row, whichever may follow
NAMES = ("", "", "user", "assistant")
END = (0, 4, 2, 0)  # cost of closing each state
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
FORCED = 8  # the symbol of rows that must go; others: 2 * class + truncated
_CLASS = {"s": 0, "u": 1, "a": 2}
_KEPT = ((S, None, None, None), (U, U, None, U), (None, None, A, None), (None,) * 4)  # by class: the state after keeping

Vector = tuple[int, ...]


def _options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """The edits that use up a row: initial, cost, state after."""
    out = [("D", DELETE, state)]
    if symbol != FORCED:
        kind, worse = divmod(symbol, 2)
        after = _KEPT[kind][state]
        if after is not None:
            out.append(("K", KEEP + worse * TRUNCATED, after))
        out.append(("R", REROLE + worse * TRUNCATED, NEXT[state]))
    return out


def _times(left: tuple[Vector, ...], right: tuple[Vector, ...]) -> tuple[Vector, ...]:
    columns = list(zip(*right))
    return tuple(tuple(min(x + y for x, y in zip(row, col)) for col in columns) for row in left)


def applied(matrix: tuple[Vector, ...], vector: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, vector)) for row in matrix)


@lru_cache(None)
def power(symbol: int, k: int) -> tuple[Vector, ...]:
    """The min-plus matrix of 2^k rows of ``symbol``, insertions ahead of each row included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    far = 1 << 40
    rows = []
    for state in STATES:
        row, at, spent = [far] * 4, state, 0
        for _ in range(3):  # a third insertion only leads back
            for _, cost, after in _options(symbol, at):
                row[after] = min(row[after], spent + cost)
            at, spent = NEXT[at], spent + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def advance(symbol: int, n: int, vector: Vector) -> Vector:
    """Costs-to-go ahead of a run of ``n`` rows, from those after it."""
    k = 0
    while n:
        if n & 1:
            vector = applied(power(symbol, k), vector)
        n, k = n >> 1, k + 1
    return vector


def _shape(vector: Vector) -> Vector:
    least = min(vector)
    return tuple(x - least for x in vector)


@lru_cache(1 << 16)
def _choices(symbol: int, after: Vector) -> tuple[tuple[str, int], ...]:
    """For each state the least cheapest edits up to and with the row, and the state after it."""
    before = applied(power(symbol, 0), after)
    out = []
    for state in STATES:
        edits = ""
        while True:
            found = [(initial, to) for initial, cost, to in _options(symbol, state) if cost + after[to] == before[state]]
            if INSERT + before[NEXT[state]] == before[state]:
                found.append(("I", NEXT[state]))
            initial, to = min(found)
            edits += initial
            state = to
            if initial != "I":
                break
        out.append((edits, state))
    return tuple(out)


def unrolled(runs: tuple[tuple[int, int], ...], after: Vector, starts: tuple[int, ...]) -> tuple[Vector, list[tuple[str, int]]]:
    """Costs-to-go ahead of ``runs`` (symbol, rows), and the edits and last state from each of ``starts``."""
    ends = []
    for symbol, n in reversed(runs):
        ends.append(after)
        after = advance(symbol, n, after)
    ends.reverse()
    tables = []
    for (symbol, n), end in zip(runs, ends):
        shapes, seen = [_shape(end)], {}
        while len(shapes) < n and shapes[-1] not in seen:  # shapes repeat from some row on
            seen[shapes[-1]] = len(shapes) - 1
            shapes.append(_shape(applied(power(symbol, 0), shapes[-1])))
        if shapes[-1] in seen and len(shapes) < n:
            again = seen[shapes.pop()]
            cycle = len(shapes) - again
            order = (j if j < len(shapes) else again + (j - again) % cycle for j in range(n - 1, -1, -1))
        else:
            order = range(n - 1, -1, -1)
        tables.append([_choices(symbol, shapes[j]) for j in order])
    out = []
    for state in starts:
        edits = []
        for table in tables:
            for row in table:
                edit, state = row[state]
                edits.append(edit)
        out.append(("".join(edits), state))
    return after, out


@lru_cache(1 << 12)
def solved(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    costs, [(edits, state)] = unrolled(runs, END, (NOTHING,))
    return costs[NOTHING], edits + "I" * (END[state] // INSERT)


def product(runs: tuple[tuple[int, int], ...]) -> tuple[Vector, ...]:
    """The matrix of all ``runs``: each unit vector after them, moved ahead of them."""
    far = 1 << 40
    columns = []
    for state in STATES:
        vector = tuple(0 if x == state else far for x in STATES)
        for symbol, n in reversed(runs):
            vector = advance(symbol, n, vector)
        columns.append(vector)
    return tuple(zip(*columns))


def turns(edits: str, rows: list[tuple[str, str] | None], state: int) -> tuple[list[tuple[str, str]], int]:
    """The repaired (role, text) rows; ``rows`` holds None where the row must go."""
    out, at = [], 0
    for edit in edits:
        if edit == "D":
            at += 1
            continue
        role, text = ("", "") if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "K":
            state = _KEPT[_CLASS[role[0]]][state]
        else:
            state = NEXT[state]
            role = NAMES[state]
        out.append((role, text))
    return out, state


class _Hash:
    """SHA-256 of ``role:text`` rows joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, rows: list[tuple[str, str]]) -> None:
        if rows:
            text = "\n".join(f"{r}:{t}" for r, t in rows)
            self.sha.update(("\n" + text if self.any else text).encode())
            self.any = True


class _Piece:
    """Consecutive rows of a conversation: its counts, runs and rows."""

    def __init__(self):
        self.n = self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = ""
        self.runs: list[list[int]] = []
        self.rows: list[tuple[str, str] | None] = []

    def add(self, symbol: int, n: int, initial: str, row: tuple[str, str] | None) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        else:
            self.runs.append([symbol, n])
        self.rows.extend([row] * n)
        self.illegal += (n - 1) + bool(self.n and self.last + initial not in _LEGAL)
        self.first = self.first if self.n else initial
        self.last = initial
        self.n += n
        self.size += len(row[1]) + 16 if row else 16 * n

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn


_LEGAL = {"su", "ua", "au"}
_MEASURES = "gaps long, blank long, duplicate long, truncated long, illegal long"
_TURNS = "array<struct<role:string,text:string>>"
_PARTS = (f"conv_id long, seq long, whole boolean, {_MEASURES}, cost long, audit string, digest string, turns {_TURNS}, "
          "n long, low long, high long, n_turns long, first string, last string, matrix array<long>, symbols array<int>, counts array<int>")
_TAILS = "tail_of long, after array<long>, ahead array<long>"
REPAIRED = f"conv_id long, chunk long, last boolean, {_MEASURES}, cost long, edits string, audit string, turns {_TURNS}, repaired_sha256 string"
_MOST = (1 << 63) - 1


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(_MOST, high - low + 1 - distinct)


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def _kinds(ddl: str) -> pa.Schema:
    """The Arrow schema of the few column types used here."""
    plain = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
             _TURNS: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))}
    return pa.schema([(c.split(" ")[0], plain[c.split(" ")[1]]) for c in ddl.split(", ")])


def _sent(rows: Iterator[dict], ddl: str, most: int = 2048) -> Iterator[pa.RecordBatch]:
    """``rows`` in record batches of bounded size."""
    kinds, held, size = _kinds(ddl), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"] or "") + 32 for t in row.get("turns") or ())
        if len(held) >= most or size >= _CHUNK_BYTES:
            yield _batch(held, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, kinds)


def _told(rows: list[tuple[str, str] | None]) -> list[dict]:
    return [{"role": r[0], "text": r[1]} if r else {"role": None, "text": None} for r in rows]


def damage(conversations: DataFrame, drop: int = 0, empty: int = 1, strip: int = 2, repeat: int = 3, rerole: int = 4, of: int = 20) -> DataFrame:
    """Damaged rows with ``copies``, by CRC-32 of ``conv_id:turn`` modulo ``of``; nulls count as one space.

    A dropped row stays as a mark of its conversation, with 0 copies.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % of
    own = conversations.select(conv.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                               F.coalesce(F.col("text").cast("string"), space).alias("text"), code.alias("code"))
    gone = F.col("code") == drop
    text = F.when(gone | (F.col("code") == empty), F.lit("")).when(F.col("code") == strip, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return own.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"),
                      F.when(gone, F.lit("")).when(F.col("code") == rerole, F.lit("user")).otherwise(F.col("role")).alias("role"),
                      text.alias("text"), F.when(gone, 0).when(F.col("code") == repeat, 2).otherwise(1).cast("long").alias("copies"))


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct rows with counts and faults, in order, each first place of a (role, text) marked by a row ahead of it."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    trimmed = F.rtrim(F.col("text"), F.lit(_WHITE))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "blank": trimmed == "",
                             "truncated": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})
    firsts = rows.where((F.col("copies") > 0) & ~F.col("blank")).groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("open"), F.min("turn").alias("least"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    marks = firsts.select("conv_id", F.when(~F.col("open"), F.col("least")).alias("turn"), "role", null("string", "text"), null("long", "copies"),
                          "digest", null("boolean", "blank"), null("boolean", "truncated"), F.lit(0).alias("kind"))
    both = rows.withColumn("kind", F.lit(1)).select(*marks.columns).unionAll(marks)
    place = ["conv_id", "turn", "role", "digest"]
    return both.repartitionByRange(*place).sortWithinPartitions(*place, "kind")


def _pieces(batches: Iterator[pa.RecordBatch], with_turns: bool, most: int) -> Iterator[dict]:
    """Finished conversations, and the pieces of those that reach a partition's edge or have over ``most`` rows."""
    part, made = TaskContext.get().partitionId(), 0

    def flat() -> Iterator[tuple]:
        for b in tokens.slices(batches, "text", _CHUNK_BYTES):
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "digest", "blank", "truncated", "kind")))

    def row(conv: int | None, p: _Piece, open_: bool) -> dict:
        nonlocal made
        runs = tuple(map(tuple, p.runs))
        out = {"conv_id": conv, "seq": (part << 36) + made, "whole": not open_, "gaps": _gaps(p.low, p.high, p.turns), "blank": p.blank,
               "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal}
        made += 1
        if open_:
            return out | {"n": p.n, "low": p.low, "high": p.high, "n_turns": p.turns, "first": p.first, "last": p.last, "turns": _told(p.rows),
                          "matrix": [x for r in product(runs) for x in r], "symbols": [r[0] for r in runs], "counts": [r[1] for r in runs]}
        cost, audit = solved(runs) if p.n <= 256 else solved.__wrapped__(runs)
        repaired, _ = turns(audit, p.rows, NOTHING)
        digest = _Hash()
        digest.add(repaired)
        return out | {"cost": cost, "audit": audit, "digest": digest.sha.hexdigest(), "turns": _told(repaired) if with_turns else None}

    held = None  # the last conversation's only piece so far
    for at, (conv, rows) in enumerate(groupby(flat(), key=lambda r: r[0])):
        if held:
            yield row(*held)
        p, mark, cut = _Piece(), None, at == 0
        for _, turn, role, text, copies, digest, blank, truncated, kind in rows:
            if kind == 0:
                mark = (turn, role, digest)
                continue
            if not copies:
                continue
            first, mark = mark == (turn, role, digest), None
            initial = role[:1]
            if p.n and (p.n >= most or p.size >= _CHUNK_BYTES):
                yield row(conv, p, True)
                p, cut = _Piece(), True
            p.turn(turn)
            if first:
                p.add(2 * _CLASS.get(initial, 3) + truncated, 1, initial, (role, text))
                p.truncated += truncated
                copies -= 1
            while copies:
                if p.n >= most:
                    yield row(conv, p, True)
                    p, cut = _Piece(), True
                    p.turn(turn)
                n = min(copies, most - p.n)
                p.add(FORCED, n, initial, None)
                p.blank += n * blank
                p.duplicate += n * (not blank)
                copies -= n
        held = (conv, p, cut)
    if held:
        yield row(held[0], held[1], True)


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Costs-to-go after and ahead of each piece; pieces come by conversation from the last."""
    own, vector = object(), END
    for b in batches:
        for conv, seq, matrix in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seq", "matrix"))):
            vector = vector if conv == own else END
            own, after = conv, vector
            vector = applied(tuple(tuple(matrix[4 * k : 4 * k + 4]) for k in STATES), after)
            yield {"tail_of": seq, "after": list(after), "ahead": list(vector)}


def _moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits and last state from every state."""
    for b in batches:
        edits, ends = [], []
        for symbols, counts, after in zip(*(b.column(c).to_pylist() for c in ("symbols", "counts", "after"))):
            _, found = unrolled(tuple(zip(symbols, counts)), tuple(after), tuple(STATES))
            edits.append([f[0] for f in found])
            ends.append([f[1] for f in found])
        keep = [c for c in b.schema.names if c not in ("symbols", "counts", "after")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(edits, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))],
                                         names=[*keep, "moves", "ends"])


def _joined(batches: Iterator[pa.RecordBatch], with_turns: bool) -> Iterator[dict]:
    """Pieces in order, from the state that the ones before left; the last has the whole conversation's figures."""

    def flat() -> Iterator[dict]:
        for b in batches:
            for k in range(b.num_rows):
                yield b.slice(k, 1).to_pylist()[0]

    for conv, own in groupby(flat(), key=lambda r: r["conv_id"]):
        state, digest, audit, held, low, distinct = NOTHING, _Hash(), [], None, None, 0
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        high, last, chunk, cost = None, None, 0, 0
        for r in own:
            if held:
                yield held
            if chunk == 0:
                cost = r["ahead"][NOTHING]
            for c in total:
                total[c] += r[c]
            if r["n"]:
                total["illegal"] += last is not None and last + r["first"] not in _LEGAL
                last = r["last"]
            distinct += r["n_turns"] - (r["low"] is not None and r["low"] == high)
            low, high = (r["low"] if low is None else low), (r["high"] if r["high"] is not None else high)
            edits = r["moves"][state]
            repaired, begun = turns(edits, [(t["role"], t["text"]) if t["role"] is not None else None for t in r["turns"]], state)
            state = r["ends"][state]
            digest.add(repaired)
            audit.append(edits)
            held = {"conv_id": conv, "chunk": chunk, "last": False, "edits": edits, "turns": _told(repaired) if with_turns else None}
            chunk += 1
        closing = "I" * (END[state] // INSERT)
        added, _ = turns(closing, [], state)
        digest.add(added)
        held["edits"] += closing
        if with_turns:
            held["turns"] += _told(added)
        yield held | total | {"last": True, "gaps": _gaps(low, high, distinct), "cost": cost, "audit": "".join(audit) + closing,
                              "repaired_sha256": digest.sha.hexdigest()}


def repair(rows: DataFrame, with_turns: bool = True, piece_rows: int = 1 << 14) -> DataFrame:
    """Repair ``rows`` (conv_id, turn, role, text, copies), in the columns of ``REPAIRED``.

    One row for each conversation, or for each piece (``chunk``) of one that has
    over ``piece_rows`` rows or lies over a partition's edge: its ``edits`` and repaired ``turns``.
    The ``last`` one has the figures, audit and digest of the whole conversation.
    """
    def run(make, ddl, *more):
        return lambda batches: _sent(make(batches, *more), ddl)

    parts = store.written(_placed(rows).mapInArrow(run(_pieces, _PARTS, with_turns, piece_rows), _PARTS), "conversation-pieces")
    whole = parts.where("whole").select("conv_id", F.lit(0).cast("long").alias("chunk"), F.lit(True).alias("last"), "gaps", "blank", "duplicate", "truncated",
                                        "illegal", "cost", F.col("audit").alias("edits"), "audit", "turns", F.col("digest").alias("repaired_sha256"))
    pieces = parts.where("NOT whole").drop("whole", "gaps", "cost", "audit", "digest")
    light = pieces.select("conv_id", "seq", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    tails = light.mapInArrow(run(_tails, _TAILS), _TAILS)
    told = pieces.drop("matrix").join(tails, F.col("seq") == F.col("tail_of")).drop("tail_of")
    kept = [f for f in told.schema.fields if f.name not in ("symbols", "counts", "after")]
    moved = told.mapInArrow(_moves, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", moves array<string>, ends array<int>")
    ordered = moved.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return whole.unionByName(ordered.mapInArrow(run(_joined, REPAIRED, with_turns), REPAIRED))

"""Binary packing and infilling against brute force, with odd rows."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyledger.llm import binary_packing, infilling


def _clash(frame):
    """Further columns whose names the operators use themselves."""
    extra = {c: F.lit("x") for c in ("length", "start", "bucket", "salt", "form", "output", "h1", "n", "place")}
    return frame.withColumns(extra)


@given(st.integers(0, 10**7), st.integers(0, 14))
def test_decomposition_is_whole_pieces_then_binary_digits(n, exponent):
    capacity = 1 << exponent
    got = binary_packing.decomposition(n, capacity) if n < 4000 * capacity else [n]
    assert sum(got) == n
    if n < 4000 * capacity:
        tail = got[n // capacity :]
        assert got[: n // capacity] == [capacity] * (n // capacity)
        assert tail == [int(d) << k for k, d in zip(range(len(bin(n % capacity)) - 3, -1, -1), bin(n % capacity)[2:]) if d == "1"]


@pytest.mark.parametrize("capacity", [1, 64, 2048])
def test_binary_packing(docs, none, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = docs.where("doc_id IS NULL OR doc_id NOT IN (52, 53)" if capacity == 1 else "true")
    got = binary_packing.pack(_clash(rows), path, capacity=capacity, ids=True).collect()
    want, lengths = collections.Counter(), collections.Counter()
    for r in rows.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for size in [capacity] * (len(ids) // capacity) + [1 << k for k in range(20, -1, -1) if len(ids) % capacity >> k & 1]:
            piece = np.array(ids[at : at + size], "<u4")
            want[r.doc_id, at, size, zlib.crc32(piece.tobytes()), len(ids), tuple(ids[at : at + size])] += 1
            lengths[size] += 1
            at += size
        assert at == len(ids)
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    for size, n in lengths.items():
        assert sorted(r.place for r in got if r.length == size) == list(range(n))
        assert {r.bucket for r in got if r.length == size} == {size.bit_length() - 1}
    assert binary_packing.pack(none, path, capacity=capacity).count() == 0


def test_batches_are_rectangles(spark, docs):
    import public_tokenizers

    packed = binary_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256)
    own = collections.defaultdict(list)
    for r in binary_packing.batches(packed, 512).collect():
        own[r.bucket, r.batch].append(r.length)
    for (bucket, batch), sizes in own.items():
        last = (bucket, batch + 1) not in own
        assert len(set(sizes)) == 1 and (sum(sizes) == 512 or last and sum(sizes) <= 512)


def test_packing_wants_a_power_of_two(docs):
    with pytest.raises(ValueError):
        binary_packing.pack(docs, "unused", capacity=96)


TEXT = st.text(st.sampled_from("ab <PSM>é中𝄞\n"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.integers(0, 127))
def test_rank_index_is_exact_within_its_error(texts, error):
    raw = "".join(texts).encode()
    data = np.frombuffer(raw, np.uint8)
    index = infilling.indexed(data, error)
    want = [len("".join(texts)[:k].encode()) for k in range(len("".join(texts)) + 1)]
    assert index.offsets(np.arange(len(want))).tolist() == want
    assert (np.abs(index.residual.astype(int)) <= error).all()


def test_rank_index_over_blocks_and_few_segments(monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("abcdefgh é中𝄞"), 50000))
    data, want = np.frombuffer(text.encode(), np.uint8), np.cumsum([0, *[len(c.encode()) for c in text]])
    assert infilling.indexed(np.frombuffer(b"x" * 5000, np.uint8)).first.tolist() == [0]
    for block in (1, 7, 4096, 1 << 20):
        if block < 4096:
            data, want = data[: want[300]], want[:301]
        else:
            data, want = np.frombuffer(text.encode(), np.uint8), np.cumsum([0, *[len(c.encode()) for c in text]])
        monkeypatch.setattr(infilling, "_BLOCK", block)
        index = infilling.indexed(data)
        assert (index.offsets(np.arange(len(want))) == want).all()
        assert block < 4096 or len(index.first) < len(want) / 20


def _brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def _infill_rows(docs):
    rng = np.random.default_rng(9)
    rows = [(int(i), "".join(rng.choice(list("ab é中𝄞\n<"), rng.integers(0, 90)))) for i in range(300)]
    rows += [(900, "has <P> inside"), (901, "<M>"), (902, "<S"), (903, "é" * 30000 + "a" * 30000 + "𝄞" * 3000), (904, None), (905, ""), (905, ""), (None, "no id")]
    return rows + [(r.doc_id, r.text) for r in docs.collect()]


def test_infilling(spark, docs, none):
    rows = _infill_rows(docs)
    frame = _clash(spark.createDataFrame(rows, "doc_id long, text string"))
    got = infilling.transform(frame)
    want = collections.Counter(_brute(*r) for r in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashed = collections.Counter((*_brute(*r)[:5], sha(_brute(*r)[5]), sha(r[1] or "")) for r in rows)
    assert collections.Counter(tuple(r) for r in infilling.digests(got).collect()) == hashed
    assert infilling.transform(none).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert collections.Counter(con.execute(infilling.SQL).fetchall()) == hashed


def test_quality_model_takes_a_document_once(spark):
    """Repeated rows, repeated labels and very long texts do not grow what the driver fits on."""
    from skyledger.llm import quality_classifier as q

    rows = [(i, " ".join(f"word{(i * 31 + k * 17) % 97}" if i % 2 else "Spam###" for k in range(60))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    one = q.trained(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = q.trained(spark.createDataFrame(rows * 5, "doc_id long, text string"), labels.unionAll(labels))
    assert all(np.array_equal(one[k], many[k]) for k in one)
    long = spark.createDataFrame([*rows, (1000, "long words " * 60000)], "doc_id long, text string")
    assert q.trained(long, labels.unionAll(spark.createDataFrame([(1000, 1)], "doc_id long, quality int")), sample_passages=16) is not None


def test_gradient_of_the_quality_model_is_the_numeric_one():
    """One step of plain descent against finite differences of the weighted log loss, by loops over bags."""
    from skyledger.llm import quality_classifier as q

    rng = np.random.default_rng(3)
    x, bag, y = rng.standard_normal((9, 5)).astype(np.float64), np.array([0, 0, 0, 1, 2, 2, 3, 3, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    m = {k: v.astype(np.float64) for k, v in q.fit(x, bag, y, hidden=4, gate=3, steps=3).items()}
    each = np.where(y == 1, 0.25, 0.25)

    def loop(m):
        loss = 0.0
        for b in range(4):
            z = [np.maximum((r - m["mean"]) / m["scale"] @ m["W"] + m["b"], 0) for r in x[bag == b]]
            e = np.array([(np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"])))) @ m["w"] for v in z])
            a = np.exp(e) / np.exp(e).sum()
            p = 1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, z)) @ m["c"] + m["d"][0])))
            loss -= each[b] * np.log(p if y[b] else 1 - p)
        return loss

    f = q._forward(m, x, bag, 4)
    want = [float(1 / (1 + np.exp(-(r @ m["c"] + m["d"][0])))) for r in f["r"]]
    assert np.allclose(f["p"], want)
    seen = {}
    rate = 1e-7
    for name in ("W", "V", "U", "w", "c", "d", "b"):
        grad = np.zeros_like(m[name])
        for at in np.ndindex(*m[name].shape):
            up, down = ({**m, name: m[name].copy()} for _ in range(2))
            up[name][at] += rate
            down[name][at] -= rate
            grad[at] = (loop(up) - loop(down)) / (2 * rate)
        seen[name] = grad
    got = q.gradients(m, x, bag, y, each)
    for name, grad in seen.items():
        assert np.allclose(got[name], grad, atol=1e-5), name

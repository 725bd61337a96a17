"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (``PASSAGE`` words each, all of the text). A
passage is encoded by its character-class bigrams and by how its words repeat,
through one hidden layer. Gated attention, w . (tanh(V z) * sigmoid(U z)),
weighs the passages (softmax within the document); a logistic unit scores the
weighted passage representation. All weights are learned together from document
labels, by Adam over the whole sample.

Scale. Scoring is one pass without a shuffle; every passage of every text is
encoded, in blocks of some MB. The model is fitted on the labelled documents of
a bounded sample (``sample_docs``, the least hashes of doc_id, and at most
``sample_passages`` of a text): the encoded passages of those documents, a few
MB, are all the driver sees. Scores are of all passages.

Labels, lang, source and doc_id are no inputs of a score. A null or empty text is
a bag with one empty passage and gets the score of that. Null labels, and labels
without a document, are not used; without any labels of both classes every score
is 0.5. Equal rows are scored each; further columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import tokens
from skyledger.llm.sampling import sample

PASSAGE = 100
_VOWEL, _LETTER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _LOUD, _MARK, _HIGH, _OTHER = range(11)
KINDS = 11
FEATURES = KINDS * KINDS + 6

Model = dict[str, np.ndarray]


def _kinds() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[0x80:] = _HIGH
    for b in range(0x21, 0x7F):
        c = chr(b)
        table[b] = (_VOWEL if c in "aeiou" else _LETTER if c.islower() else _UPPER if c.isupper() else _DIGIT if c.isdigit()
                    else _SYMBOL if c in "#*$%&|<>" else _LOUD if c in "!?" else _MARK)
    table[list(tokens.WHITE)] = _SPACE
    table[0x0A] = _LINE
    return table


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the first passage of each text (one more than texts)."""
    data, offsets = tokens.raw(texts)
    t = tokens.tokenise(texts, tokens.white_table(lower=False))
    words = np.diff(t.starts)
    bags = np.maximum(1, -(-words // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    total = int(first[-1])
    place = np.arange(len(t.codes)) - np.repeat(t.starts[:-1], words)
    of_word = np.repeat(first[:-1], words) + place // PASSAGE
    kind = _kinds()[data]
    solid = (kind != _SPACE) & (kind != _LINE)
    fresh = np.ones(len(data), bool)
    fresh[1:] = ~solid[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = np.flatnonzero(solid & fresh)  # one for each word
    heads = begins[place % PASSAGE == 0]
    turn = np.zeros(len(data), np.int64)
    turn[heads[place[place % PASSAGE == 0] > 0]] = 1  # the first passage of a text starts with the text
    of_byte = np.repeat(first[:-1], np.diff(offsets))
    step = np.cumsum(turn)
    at = np.concatenate([[0], step])[offsets[:-1]]
    of_byte = of_byte + step - np.repeat(at, np.diff(offsets))
    pair = of_byte[:-1] * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    pair = pair[of_byte[:-1] == of_byte[1:]]
    grams = np.bincount(pair, minlength=total * KINDS * KINDS).reshape(total, -1).astype(np.float32)
    size = np.bincount(of_byte, minlength=total).astype(np.float32)
    n = np.bincount(of_word, minlength=total).astype(np.float32)
    vocabulary = max(1, len(t.words))
    types = np.bincount(np.unique(of_word * vocabulary + t.codes) // vocabulary, minlength=total)
    again = (t.codes[1:] == t.codes[:-1]) & (of_word[1:] == of_word[:-1])
    repeats = np.bincount(of_word[1:][again], minlength=total)
    some = np.maximum(n, 1)
    more = np.stack([types / some, repeats / some, (size - n) / some / 10, n / PASSAGE, np.log1p(np.repeat(words, bags)) / 10, n == 0], 1)
    return np.concatenate([np.sqrt(grams / np.maximum(size, 1)[:, None]), more.astype(np.float32)], 1), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: Model, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
    """Hidden passages, attention and score of every bag; ``bag`` is each passage's bag, ascending."""
    z = np.maximum((x - m["mean"]) / m["scale"] @ m["W"] + m["b"], 0)
    t, g = np.tanh(z @ m["V"]), _sigmoid(z @ m["U"])
    e = (t * g) @ m["w"]
    starts = np.searchsorted(bag, np.arange(bags))
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    r = np.add.reduceat(a[:, None] * z, starts, axis=0)
    return {"z": z, "t": t, "g": g, "a": a, "r": r, "starts": starts, "p": _sigmoid(r @ m["c"] + m["d"])}


def gradients(m: Model, x: np.ndarray, bag: np.ndarray, y: np.ndarray, each: np.ndarray, xs: np.ndarray | None = None) -> Model:
    """Of the log loss of the bags, each weighing ``each``, by every learned weight; ``xs``: ``x`` standardised."""
    xs = (x - m["mean"]) / m["scale"] if xs is None else xs
    f = _forward(m, x, bag, len(y))
    z, t, g, a = f["z"], f["t"], f["g"], f["a"]
    dp = (f["p"] - y) * each
    dr = dp[:, None] * m["c"]
    da = (dr[bag] * z).sum(1)
    de = a * (da - np.add.reduceat(a * da, f["starts"])[bag])
    dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
    dz = (a[:, None] * dr[bag] + dt @ m["V"].T + dg @ m["U"].T) * (z > 0)
    return {"W": xs.T @ dz, "b": dz.sum(0), "V": z.T @ dt, "U": z.T @ dg, "w": (t * g).T @ de, "c": f["r"].T @ dp, "d": dp.sum(keepdims=True)}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 250, rate: float = 0.02, decay: float = 1e-4, seed: int = 1) -> Model:
    """Learn all weights from bag labels ``y`` (0 or 1), the classes weighing alike."""
    rng = np.random.default_rng(seed)
    width, bags = x.shape[1], len(y)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"mean": x.mean(0), "scale": x.std(0) + 0.01, "W": draw(width, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate),
         "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1, np.float32)}
    learned = ("W", "b", "V", "U", "w", "c", "d")
    mom = {k: (np.zeros_like(m[k]), np.zeros_like(m[k])) for k in learned}
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    xs = (x - m["mean"]) / m["scale"]
    for step in range(1, steps + 1):
        grad = gradients(m, x, bag, y, each, xs)
        for k in learned:
            u, v = mom[k]
            d = grad[k] + decay * m[k]
            u[...] = 0.9 * u + 0.1 * d
            v[...] = 0.999 * v + 0.001 * d * d
            m[k] = m[k] - rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m


def scores(m: Model | None, texts: pa.Array) -> np.ndarray:
    if m is None:
        return np.full(len(texts), 0.5)
    x, first = encode(texts)
    return _forward(m, x, np.repeat(np.arange(len(texts)), np.diff(first)), len(texts))["p"].astype(float)


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(of))


def trained(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, held_out: int = 2, sample_docs: int = 4000, sample_passages: int = 256) -> Model | None:
    """The model fitted on at most ``sample_docs`` labelled documents outside the held-out fold.

    A doc_id counts once, with its largest label and the least of its texts; of a
    longer text the fit takes ``sample_passages`` passages, evenly spread.
    """
    own = labels.where(F.col(column).isin(0, 1) & (remainder(F.col("doc_id"), folds) != held_out))
    own = sample(own.groupBy("doc_id").agg(F.max(column).alias("y")), sample_docs)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text", 4 << 20):
            x, first = encode(b.column("text"))
            bags = []
            for i, j in zip(first[:-1], first[1:]):
                own = x[i:j]
                if len(own) > sample_passages:
                    own = own[np.linspace(0, len(own) - 1, sample_passages).round().astype(int)]
                bags.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text").mapInArrow(run, "doc_id long, y int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"], r["bag"]))
    y = np.array([r["y"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, sample_docs: int = 4000) -> DataFrame:
    """``docs`` with held_out, score and predicted (1: score of ``threshold`` or more); columns so named are replaced."""
    return classified(docs, trained(docs, labels, folds=folds, held_out=held_out, sample_docs=sample_docs), folds, held_out, threshold)


def classified(docs: DataFrame, model: Model | None, folds: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """``classify`` under a model; None: every score is 0.5."""
    docs = docs.drop("held_out", "score", "predicted").withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(model, b.column("text")), pa.float64())], names=[*b.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    out = docs.mapInArrow(run, schema)
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))

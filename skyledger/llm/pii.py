"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (email, ip, card, phone). Around them each
document gets a chain of candidate tokens (numbers, addresses and the local
parts of its emails). Candidates under a base span are observed. A log-linear
model of a candidate's form gives the others' own potentials; neighbours in the
chain share a weak potential, and candidates that repeat or resemble one another
anywhere in the document (same last seven digits, same local part) share a
strong one. Loopy sum-product over this graph makes the labels agree: a phone
number given once with its country code and once without is found both times.
The field runs on every document with a candidate that is not observed, base
spans or not: a number given twice can be found by its form and its repeat alone.
Repeats are linked to the first observed span of each kind of their key, or, if
the patterns saw none, one to the next: edges grow with the document, not with
the square of a repeat's count, and no number of repeats outvotes a pattern.

Scale. A document is labelled within its row: nothing is shuffled. The form
model is fitted on the candidates of a bounded sample of documents
(``sample_docs``), labelled by the patterns.

Null and empty texts have no spans; equal rows are scanned each; further columns
are ignored; empty tables give no rows (and an unfitted model that adds nothing).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import tokens
from skyledger.llm.sampling import sample

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[0-9\x20().-]*[0-9])?")
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an ``@`` that a domain follows."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans that the patterns find, by kind as listed, then start."""
    out = [("email", a, z) for a, z in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _features(form: str) -> list[float]:
    d = _digits(form)
    n = len(d)
    return [1.0, "@" in form, form.count(".") == 3, form.count(".") > 3, n < 4, 4 <= n < 8, 8 <= n < 16, 16 <= n < 20, n >= 20, form[:1] == "+",
            "(" in form, "-" in form, n >= 16 and luhn(d), any(c.isalpha() for c in form)]


FEATURES = len(_features("0"))


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """Start, end, label (0: not observed; else 1 + kind) and likeness key of each candidate, in order."""
    out = {}
    for m in _NUMBER.finditer(text):
        d = _digits(m[0])
        out[m.start(), m.end()] = (0, f"#{d[-7:]}" if len(d) >= 7 else "")
    locals_ = {p.lower() for k, a, z in base if k == "email" for p in (text[a:z].split("@")[0],) if len(p) >= 5 and not p.isalpha()}
    if locals_:
        for m in _LOCAL_PART.finditer(text):
            if (name := m[0].strip(".").lower()) in locals_:
                a = m.start() + len(m[0]) - len(m[0].lstrip("."))
                out[a, a + len(name)] = (0, name)
    covered = np.zeros(len(text) + 1, np.int8) if base else None
    for k, a, z in base:
        covered[a:z] = 1
    out = {s: v for s, v in out.items() if covered is None or not covered[s[0] : s[1]].any()}
    for k, a, z in base:
        form = text[a:z]
        d = _digits(form)
        out[a, z] = (1 + KINDS.index(k), form.split("@")[0].lower() if k == "email" else f"#{d[-7:]}")
    return [(a, z, label, key) for (a, z), (label, key) in sorted(out.items())]


def fit(examples: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None, steps: int = 300, rate: float = 1.0) -> np.ndarray:
    """Multinomial logistic weights (features by labels) of a candidate's form, each example as often as ``times`` says; without examples, everything is label 0."""
    w = np.zeros((FEATURES, 1 + len(KINDS)))
    if not len(examples):
        w[0, 0] = 6.0
        return w
    target = np.eye(1 + len(KINDS))[labels]
    part = np.ones(len(examples)) if times is None else np.asarray(times, float)
    part = (part / part.sum())[:, None]
    for _ in range(steps):
        z = examples @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (examples.T @ (part * (p - target)) + 1e-4 * w)
    return w


def marginals(own: np.ndarray, edges: np.ndarray, weights: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Loopy sum-product: label marginals of nodes with log potentials ``own`` under agreeing edges."""
    both = np.concatenate([edges, edges[:, ::-1]])
    strength = np.concatenate([weights, weights])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(both), own.shape[1]))
    for _ in range(rounds if len(both) else 0):
        belief = own.copy()
        np.add.at(belief, both[:, 1], messages)
        out = belief[both[:, 0]] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(out.sum(axis=1, keepdims=True) + np.expm1(strength)[:, None] * out)
        new -= new.max(axis=1, keepdims=True)
        if np.abs(new - messages).max() < 1e-4:
            break
        messages = 0.5 * messages + 0.5 * new
    belief = own.copy()
    np.add.at(belief, both[:, 1], messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label(text: str, weights: np.ndarray, near: float = 0.2, alike: float = 9.0, reach: int = 30, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, by kind as listed, then start."""
    base = base_spans(text)
    nodes = candidates(text, base)
    if len(nodes) == len(base):
        return base, base
    own = np.clip(np.array([_features(text[a:z]) for a, z, _, _ in nodes], float) @ weights, -3.0, 3.0)
    for k, (_, _, seen, _) in enumerate(nodes):
        if seen:
            own[k] = -1e9  # more than all messages of a document
            own[k, seen] = 1e9
    edges, strength, last = [], [], {}
    observed: dict[str, dict[int, int]] = {}  # of each key, the first span of each kind
    for k, (_, _, seen, key) in enumerate(nodes):
        if seen and key:
            observed.setdefault(key, {}).setdefault(seen, k)
    for k, (a, _, _, key) in enumerate(nodes):
        if k and a - nodes[k - 1][1] <= reach:
            edges.append((k - 1, k))
            strength.append(near)
        if key:
            like = [] if seen else observed[key].values() if key in observed else [last[key]] if key in last else []
            edges += [(s, k) for s in like]
            strength += [alike] * len(like)
            last[key] = k
    p = marginals(own, np.array(edges, np.int64).reshape(-1, 2), np.array(strength, float))
    out = list(base)
    for k, (a, z, seen, _) in enumerate(nodes):
        best = int(p[k].argmax())
        if not seen and best and p[k, best] >= sure:
            out.append((KINDS[best - 1], a, z))
    return base, sorted(set(out), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _texts(frame: DataFrame) -> DataFrame:
    return frame.withColumn("text", F.col("text").cast("string"))


def _marked(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """Row and text of those rows of a batch that hold a digit or an ``@``."""
    data, offsets = tokens.raw(batch.column("text"))
    marked = np.concatenate([[0], np.cumsum(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))])
    for k in np.flatnonzero(np.diff(marked[offsets])).tolist():
        yield k, batch.column("text")[k].as_py()


def trained(docs: DataFrame, sample_docs: int = 4000) -> np.ndarray:
    """The form weights, fitted on the candidates of at most ``sample_docs`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text"):
            found = {}
            for _, text in _marked(b):
                for a, z, seen, _ in candidates(text, base_spans(text)):
                    row = (*map(float, _features(text[a:z])), float(seen))
                    found[row] = found.get(row, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in found], pa.list_(pa.float64())), pa.array(list(found.values()), pa.int64())], names=["row", "n"])

    rows = _texts(sample(docs, sample_docs)).select("text").mapInArrow(run, "row array<double>, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    table = np.array([r["row"] for r in sorted(rows, key=lambda r: r["row"])], float).reshape(-1, FEATURES + 1)
    return fit(table[:, :-1], table[:, -1].astype(int), np.array([r["n"] for r in sorted(rows, key=lambda r: r["row"])], float))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """doc_id, the base counts by kind, the digest of the base spans and all spans."""
    weights = trained(docs, sample_docs)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text"):
            counts, sha, every = np.zeros((len(KINDS), b.num_rows), np.int64), [nothing] * b.num_rows, [""] * b.num_rows
            for row, text in _marked(b):
                base, spans = label(text, weights)
                for k, _, _ in base:
                    counts[KINDS.index(k), row] += 1
                sha[row], every[row] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)
            out = [b.column("doc_id"), *map(pa.array, counts), pa.array(sha, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return _texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(docs: DataFrame, sample_docs: int = 4000) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; other columns stay (a null text too)."""
    weights = trained(docs, sample_docs)
    docs = _texts(docs)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text"):
            texts = b.column("text").to_pylist()
            for row, text in _marked(b):
                out, end = [], 0
                for kind, a, z in sorted(label(text, weights)[1], key=lambda s: (s[1], -s[2])):
                    if z <= end:
                        continue
                    out += [text[end:a], f"<{kind}>"] if a >= end else []
                    end = z
                texts[row] = "".join([*out, text[end:]])
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)

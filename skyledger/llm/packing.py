"""Vector best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised on the executors; only those over the capacity are cut.
Every sequence has three capacities: tokens, pieces ("documents") and attention
cost (the sum of squared piece lengths). Pieces go, longest first, into the
open sequence that scores best by weighted dot product (or smallest weighted
residual norm) of what is left, among those that meet all three capacities.

Scale. A piece's vector depends on its length alone, so the packing is planned
over the histogram of lengths (``capacity`` numbers, whatever the corpus), with
equal sequences handled as one group: the plan is a short list of rules
"the pieces of length L with ranks from..to go to sequences s.., at offset o".
Ranks come from row numbers in (length, salt) groups, so a length that holds a
third of all rows is spread over many tasks. Each task then looks its pieces up
in the rules. The same plan holds for 200 documents and for 10^11.

Null and empty texts are one piece of the end token; equal rows (also repeated
document ids) are packed each; other columns of the input are ignored; an empty
input gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import store, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Plan(NamedTuple):
    """``rules`` rows: length, first rank, rank after the last, first sequence, offset."""

    rules: np.ndarray
    sequences: int


BALANCED = (1.0, 1.0, 1.0)  # tokens, pieces and attention cost weigh alike
_CACHED_WORDS = 1 << 19  # in each Python worker; further words are tokenised again in each batch
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_BYTE_CHARS = {b: b for b in _kept} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_kept)))}


class WordEncoder:
    """Token ids of whole texts, tokenising each distinct word once.

    The tokenizer lower-cases, drops white space and cuts letters from marks,
    so a text's ids are those of its letter runs and mark runs in order. Words
    of lower-case Latin letters go to the merges directly, others through the
    whole tokenizer. Texts where a cut could matter (combining marks, the marks
    of special tokens) are tokenised whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.number: dict[str, int] = {}  # word to its place in first and size
        self.ids, self.first, self.size = array("I"), array("q"), array("q")
        self.table = tokens.white_table()
        kind = np.zeros(256, np.uint8)  # 1: letter, 2: mark that no rule of the tokenizer joins to letters
        kind[0x61:0x7B] = 1
        kind[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27]] = 2
        self.kind = kind

    def words(self, words: list[str]) -> np.ndarray:
        """Places of ``words`` in ``first`` and ``size``; new words are tokenised."""
        if len(self.number) > _CACHED_WORDS:
            self.number.clear()
            self.ids, self.first, self.size = array("I"), array("q"), array("q")
        new = [w for w in words if w not in self.number]
        for plain, encode in ((True, self.merges), (False, self.whole)):
            own = [w for w in new if bool(_LATIN.fullmatch(w)) is plain]
            for at in range(0, len(own), 20000):
                some = own[at : at + 20000]
                forms = [w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS) for w in some] if plain else some
                for w, e in zip(some, encode.encode_batch_fast(forms, add_special_tokens=False)):
                    self.number[w] = len(self.first)
                    self.first.append(len(self.ids))
                    self.ids.extend(e.ids)
                    self.size.append(len(self.ids) - self.first[-1])
        return np.fromiter((self.number[w] for w in words), np.int64, len(words))

    def texts(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and where each text starts."""
        data, offsets = tokens.raw(texts)
        n = len(offsets) - 1
        low, nxt = data[:-1], data[1:]
        odd = np.flatnonzero(((low == 0x3C) & (nxt == 0x7C)) | (low == 0xCC) | (low == 0xCD))
        odd = np.unique(np.searchsorted(offsets, odd, side="right") - 1).tolist()
        if odd:
            mask = np.zeros(n, bool)
            mask[odd] = True
            data, offsets = tokens.raw(pc.if_else(pa.array(mask), "", pc.fill_null(texts, "")))
        data = self.table[data]
        kind = self.kind[data]
        after = np.zeros(len(data), bool)  # the last byte of a Latin-1 letter
        after[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut = 1 + np.flatnonzero((((kind[:-1] == 1) | after[:-1]) & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1)))
        spaced, moved = np.insert(data, cut, tokens.SPACE), offsets + np.searchsorted(cut, offsets, side="left")
        parts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(moved)), pa.py_buffer(spaced))
        t = tokens.tokenise(parts, np.arange(256, dtype=np.uint8))
        place = self.words(t.words.to_pylist())
        first, size = (np.frombuffer(x, np.int64)[place] if len(place) else np.zeros(0, np.int64) for x in (self.first, self.size))
        per_token = size[t.codes]
        flat = tokens.gathered(np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32), first[t.codes], per_token)
        upto = np.concatenate([[0], np.cumsum(per_token)])[t.starts]
        out = np.full(len(flat) + n, end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[upto[1:] + np.arange(n)] = False
        out[keep] = flat
        starts = upto + np.arange(n + 1)
        for doc in reversed(odd):
            ids = np.array(self.whole.encode(texts[doc].as_py(), add_special_tokens=False).ids, np.uint32)
            out = np.insert(out, starts[doc], ids)
            starts[doc + 1 :] += len(ids)
        return out, starts


_encoders: dict[str, WordEncoder] = {}


def encoded(texts: pa.Array, path: str, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``WordEncoder.texts`` with one encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path].texts(texts, end)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), in the columns of ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text"):
            ids, starts = encoded(b.column("text"), tokenizer, end)
            view, rows = memoryview(ids.astype("<u4").view(np.uint8)), []
            for doc, a, z in zip(b.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                for k, at in enumerate(range(a, z, capacity)):
                    to = min(at + capacity, z)
                    rows.append((doc, k, at - a, to - at, zlib.crc32(view[4 * at : 4 * to])))
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(histogram: dict[int, int], capacity: int = 2048, max_docs: int | None = None, max_cost: int | None = None,
             weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rank_by: str = "dot") -> Plan:
    """Plan vector best-fit over ``histogram`` (piece length to number of pieces).

    ``rank_by`` "dot": the feasible group with the smallest weighted dot
    product of residual and item vector, in parts of the capacities; "norm": that with the
    smallest weighted norm of what would be left. Ties go to the older group.
    """
    if rank_by not in ("dot", "norm"):
        raise ValueError(f"rank_by is dot or norm, not {rank_by}")
    max_docs = capacity if max_docs is None else max_docs
    max_cost = capacity * capacity if max_cost is None else max_cost
    caps = np.array([capacity, max_docs, max_cost], np.int64)
    weight = np.array(weights, float)
    left = np.zeros((64, 3), np.int64)  # residuals of each group of equal sequences
    count = np.zeros(64, np.int64)  # sequences in it
    first = np.zeros(64, np.int64)  # its lowest sequence number
    groups, made, rules = 0, 0, []

    def add(residual: np.ndarray, n: int, at: int) -> None:
        nonlocal left, count, first, groups
        if groups == len(count):
            alive = np.flatnonzero(count)
            if len(alive) < len(count) // 2:
                left[: len(alive)], count[: len(alive)], first[: len(alive)] = left[alive], count[alive], first[alive]
                count[len(alive) :], groups = 0, len(alive)
            else:
                left, count, first = (np.concatenate([x, np.zeros_like(x)]) for x in (left, count, first))
        left[groups], count[groups], first[groups] = residual, n, at
        groups += 1

    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens meets no empty sequence")
        rank, n = 0, histogram[length]
        while rank < n:
            fits = np.flatnonzero((count[:groups] > 0) & (left[:groups] >= item).all(axis=1))
            if len(fits):
                if rank_by == "dot":
                    score = (left[fits] / caps) @ (weight * item / caps)
                else:
                    score = (weight * ((left[fits] - item) / caps) ** 2).sum(axis=1)
                g = int(fits[np.argmin(score)])
                take = min(int(count[g]), n - rank)
                residual, at = left[g].copy(), int(first[g])
                count[g] -= take
                first[g] += take
            else:
                take, residual, at = n - rank, caps, made
                fill = max(1, min(int(k) for k in caps // item))
                take = -(-take // fill)  # opened only as far as pieces of this length alone need
                made += take
            rules.append((length, rank, rank + take, at, capacity - int(residual[0])))
            rank += take
            if ((residual - item)[:2] > 0).all():
                add(residual - item, take, at)
    return Plan(np.array(rules, np.int64).reshape(-1, 5), made)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_docs: int | None = None, max_cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rank_by: str = "dot", end: int = 0) -> DataFrame:
    """Pack ``docs``; the pieces with their ``sequence_id`` and ``offset`` (gapless from 0)."""
    spark = docs.sparkSession
    cut = store.written(pieces(docs, tokenizer, capacity, end), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    plan = best_fit(histogram, capacity, max_docs, max_cost, weights, rank_by)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("ahead"))
    row = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("row", row).join(ahead, ["length", "salt"])
    ranked = ranked.select(*cut.columns, (F.col("row") - 1 + F.col("ahead")).alias("rank"))
    rules = plan.rules[np.lexsort((plan.rules[:, 1], plan.rules[:, 0]))] if len(plan.rules) else plan.rules
    shared = spark.sparkContext.broadcast(rules)  # bounded by the capacity, not by the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        keys = (r[:, 0] << 46) + r[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 46) + rank, side="right") - 1
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(r[at, 3] + rank - r[at, 1]), pa.array(r[at, 4])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")

"""Benchmark decontamination with a document-sharded positional inverted index.

Every shard (some MB of whole documents) gets an index: for each term the
sorted list of its positions. A test window, ``window`` consecutive words of an
item, starts from the list of its rarest term in the shard; that list, less the
term's offset, holds the possible starts, and the lists of the other terms,
rarest first, are intersected with it at their own offsets. What is left are
exact phrase matches; a second pass over the same lists finds windows whose
words all lie, in any order, within a span of ``within`` words.

Scale. A document is in one shard with all its positions, so documents are
never shuffled, and no term's postings meet in one task, however frequent it
is. The test windows are a stated query set held against all documents: they
are dealt into blocks of at most ``block_bytes`` and each block is broadcast;
one block is usual, and every further block is one more pass over the
documents whose matches so far travel with them.

Null and empty texts have no words; items without words have no windows; an
item shorter than ``window`` is one window; equal windows of several items
count for each of them; equal rows are judged each; a null item id is the
empty string; empty tables and further columns are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import store, tokens

_CARRIED = "doc_id long, text string, cover binary, items array<string>, n_near long"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"
_PROBES = 1 << 20  # candidate starts held at once


class Windows(NamedTuple):
    """Test windows as a matrix of term numbers, -1 after the last word."""

    terms: pa.Array
    matrix: np.ndarray
    items: list[list[str]]


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """The distinct windows of all items with the items they occur in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text"):
            t = tokens.tokenise(b.column("text"), tokens.alnum_table())
            words = t.words.to_pylist()
            ids, texts = [], []
            for item, a, z in zip(b.column("item_id").to_pylist(), t.starts[:-1].tolist(), t.starts[1:].tolist()):
                own = [words[c] for c in t.codes[a:z].tolist()]
                for at in range(max(1, len(own) - window + 1) if own else 0):
                    ids.append(item or "")
                    texts.append(" ".join(own[at : at + window]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ids, pa.string())], names=["phrase", "item_id"])

    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "phrase string, item_id string").groupBy("phrase").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def _block(rows: list, window: int) -> Windows:
    split = [r["phrase"].split(" ") for r in rows]
    number: dict[str, int] = {}
    matrix = np.full((len(rows), window), -1, np.int32)
    for k, words in enumerate(split):
        matrix[k, : len(words)] = [number.setdefault(w, len(number)) for w in words]
    return Windows(pa.array(list(number), pa.string()), matrix, [r["items"] for r in rows])


class Index:
    """Positions of each term of a shard: ``keys`` holds term * size + position, sorted."""

    def __init__(self, shard: tokens.Tokens):
        self.codes, self.starts, self.size = shard.codes, shard.starts, max(1, len(shard.codes))
        self.words = shard.words
        self.count = np.bincount(self.codes, minlength=len(self.words))
        self.first = np.cumsum(self.count) - self.count
        self.postings = np.argsort(self.codes, kind="stable")
        self.keys = self.codes[self.postings].astype(np.int64) * self.size + self.postings
        self.doc = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``terms`` its whole postings list: which term, which position."""
        sizes = self.count[terms]
        return np.repeat(np.arange(len(terms)), sizes), tokens.gathered(self.postings, self.first[terms], sizes)

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term has a posting from ``low`` to ``high``, both included."""
        at = np.searchsorted(self.keys, term * self.size + low)
        return self.keys[np.minimum(at, len(self.keys) - 1)] <= term * self.size + high

    def search(self, test: Windows, within: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of matches: window, position, and whether it is a phrase's start or a near match's anchor."""
        if not len(self.codes) or not len(test.matrix):
            return
        code = pc.fill_null(pc.index_in(test.terms, value_set=self.words.cast(pa.string())), -2).to_numpy(zero_copy_only=False)
        matrix = np.where(test.matrix >= 0, code[test.matrix], -1)
        alive = np.flatnonzero((matrix != -2).all(axis=1))
        if not len(alive):
            return
        matrix = matrix[alive]
        length = (matrix >= 0).sum(axis=1)
        rare = np.argsort(np.where(matrix >= 0, self.count[np.maximum(matrix, 0)], np.iinfo(np.int64).max), axis=1, kind="stable")
        load = np.cumsum(self.count[matrix[np.arange(len(matrix)), rare[:, 0]]])
        cuts = np.searchsorted(load, np.arange(_PROBES, load[-1] + _PROBES, _PROBES), side="left") + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(matrix)]):
            if a < min(z, len(matrix)):
                yield from self._intersect(matrix[a:z], rare[a:z], length[a:z], alive[a:z], within)

    def _intersect(self, matrix, rare, length, number, within):
        row = np.arange(len(matrix))
        w, anchor = self.lists(matrix[row, rare[:, 0]])
        start = anchor - rare[w, 0]
        doc = self.doc[anchor]
        low, high = self.starts[doc], self.starts[doc + 1]
        phrase = (start >= low) & (start + length[w] <= high)
        for k in range(1, matrix.shape[1]):
            left = np.flatnonzero(phrase)
            column = rare[w[left], k]
            term = matrix[w[left], column]
            here = start[left] + column  # is the adjusted position in that term's list?
            phrase[left] = (term < 0) | (self.codes[np.where(term < 0, 0, here)] == term)
        yield number[w[phrase]], start[phrase], length[w[phrase]], np.ones(int(phrase.sum()), bool)
        near = ~phrase & (within > 0)
        span_low, span_high = np.maximum(low, anchor - within + 1), np.minimum(high, anchor + within) - 1
        for k in range(1, matrix.shape[1]):
            left = np.flatnonzero(near)
            term = matrix[w[left], rare[w[left], k]].astype(np.int64)
            near[left] = (term < 0) | self.within(np.maximum(term, 0), span_low[left], span_high[left])
        left = np.flatnonzero(near)
        found = np.zeros(len(left), bool)
        for back in range(within):
            a = anchor[left] - back
            ok = a >= low[left]
            for k in range(1, matrix.shape[1]):
                term = matrix[w[left], rare[w[left], k]].astype(np.int64)
                ok &= (term < 0) | self.within(np.maximum(term, 0), np.maximum(a, 0), np.minimum(a + within, high[left]) - 1)
            found |= ok
        left = left[found]
        yield number[w[left]], anchor[left], length[w[left]], np.zeros(len(left), bool)


def _matched(batches: Iterator[pa.RecordBatch], test: Windows, within: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[set], np.ndarray, np.ndarray]]:
    for b in tokens.slices(batches, "text"):
        shard = tokens.tokenise(b.column("text"), tokens.alnum_table())
        n, size = b.num_rows, len(shard.codes)
        edge = np.zeros(size + 1, np.int64)
        for k, old in enumerate(b.column("cover").to_pylist()):
            if old:
                spans = np.frombuffer(old, np.int64).reshape(-1, 2) + shard.starts[k]
                np.add.at(edge, spans[:, 0], 1)
                np.add.at(edge, spans[:, 1], -1)
        items = [set(x or ()) for x in b.column("items").to_pylist()]
        pairs = []
        index = Index(shard)
        for number, at, length, phrase in index.search(test, within):
            pairs.append(np.unique((index.doc[at] * len(test.matrix) + number) * 2 + phrase))
            np.add.at(edge, at[phrase], 1)
            np.add.at(edge, (at + length)[phrase], -1)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        for pair in (pairs[pairs % 2 == 1] // 2).tolist():
            doc, number = divmod(pair, len(test.matrix))
            items[doc].update(test.items[number])
        near = np.bincount(np.unique(pairs // 2) // max(1, len(test.matrix)), minlength=n)
        near = near + pc.fill_null(b.column("n_near"), 0).to_numpy(zero_copy_only=False)
        yield b, (np.cumsum(edge) > 0)[:size], items, near, shard.starts


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, within: int = 16, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: its words, those inside a benchmark window, the items, ``n_near``.

    ``n_near`` counts the windows whose words all lie within ``within`` words
    of the document, in any order (phrase matches are among them).
    """
    spark = docs.sparkSession
    test = store.written(windows(benchmark, window), "windows")
    bytes_ = test.agg(F.sum(F.octet_length("phrase") + 32 + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    blocks = max(1, -(-bytes_ // block_bytes))
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.lit(None).cast("binary").alias("cover"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_near"))

    def summary(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, hit, items, near, starts in _matched(batches, shared.value, within):
                upto = np.concatenate([[0], np.cumsum(hit)])
                n_hit = upto[starts[1:]] - upto[starts[:-1]]
                sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                out = [b.column("doc_id"), pa.array(np.diff(starts)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array(n_hit > 0), pa.array(near, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"])
        return run

    def carried(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, hit, items, near, starts in _matched(batches, shared.value, within):
                cover = []
                for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    turn = np.diff(np.concatenate([[0], hit[a:z].astype(np.int8), [0]]))
                    cover.append(np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)], 1).astype(np.int64).tobytes())
                out = [b.column("doc_id"), b.column("text"), pa.array(cover, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(near, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text", "cover", "items", "n_near"])
        return run

    for block in range(blocks):
        rows = test.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).orderBy("phrase").collect()
        shared = spark.sparkContext.broadcast(_block(rows, window))
        if block + 1 < blocks:
            state = store.written(state.mapInArrow(carried(shared), _CARRIED), "matches")
    return state.mapInArrow(summary(shared), RESULT)

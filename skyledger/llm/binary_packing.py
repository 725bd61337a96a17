"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded.

A document of n tokens (end token included) is cut, from its start, into whole
pieces of ``capacity`` tokens and then into the pieces that the binary digits of
the rest name, longest first: 4,500 tokens at a capacity of 2048 are 2048, 2048,
256, 128, 16, 4. Every piece is a sequence of its own; its length is a power of
two, so it needs no padding and all its tokens are of one document. Pieces of
equal length share a bucket (the exponent). A bucket's sequences are numbered
without gaps, so a trainer takes ``batch_tokens / length`` of them at a time
(``batches``) and every batch is one dense rectangle of equal work.

Scale. Tokens are made once, on the executors, one slice of an Arrow batch at a
time; a document's pieces are at most its whole ones and one for each binary
digit. There are at most 1 + log2(capacity) buckets, whatever the corpus, and the commonest
one can hold most pieces: numbers therefore come from row numbers within
(bucket, salt) groups plus the counts of the salts ahead. Nothing but counts by
(bucket, salt) is gathered anywhere.

Null and empty texts are the end token alone, a piece of length 1; equal rows
(also repeated or null document ids) are cut each; other columns of the input
are ignored, whatever their names; an empty input gives no rows; very long
texts are cut whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import store, tokens
from skyledger.llm.packing import encoded

PIECES = "doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long"
_BUCKET_BITS = 48  # a sequence number is its bucket and its place there


def decomposition(n: int, capacity: int) -> list[int]:
    """The piece lengths of ``n`` tokens in order: whole capacities, then the binary digits of the rest."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, ids: bool = False) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text), in the columns of ``PIECES``; ``ids`` adds its token ids."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"a capacity is a power of two, not {capacity}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "text", 2 << 20):
            flat, starts = encoded(b.column("text"), tokenizer, end)
            flat = np.ascontiguousarray(flat.astype("<u4"))
            view = memoryview(flat.view(np.uint8))
            rows, cuts = [], [0]
            for doc, a, z in zip(b.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                at = a
                for length in decomposition(z - a, capacity):
                    rows.append((doc, at - a, length, length.bit_length() - 1, zlib.crc32(view[4 * at : 4 * (at + length)]), z - a))
                    at += length
                    cuts.append(at)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            out = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens"]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, PIECES + (", ids array<int>" if ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, ids: bool = False) -> DataFrame:
    """The pieces, each a sequence: its number, its place in its bucket and ``offset`` 0."""
    spark = docs.sparkSession
    cut = store.written(pieces(docs, tokenizer, capacity, end, ids), "binary-pieces")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("bucket", "salt").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("salt"))
    ahead = counts.select("bucket", "salt", (upto - F.col("n")).alias("ahead"))
    row = F.row_number().over(Window.partitionBy("bucket", "salt").orderBy("doc_id", "start", "ids_crc32"))
    place = (F.col("row") - 1 + F.col("ahead")).alias("place")
    ranked = salted.withColumn("row", row).join(ahead, ["bucket", "salt"]).select(*cut.columns, place)
    number = F.shiftleft(F.col("bucket").cast("long"), _BUCKET_BITS) + F.col("place")
    return ranked.select(*cut.columns, "place", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def batches(packed: DataFrame, batch_tokens: int) -> DataFrame:
    """``packed`` with ``batch``: consecutive sequences of one bucket, ``batch_tokens`` tokens of them (one sequence at least).

    Only the last batch of a bucket can hold fewer.
    """
    each = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("length")))
    return packed.withColumn("batch", F.floor(F.col("place") / each).cast("long"))

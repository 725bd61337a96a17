"""Substring search from an index of character n-grams.

A text that holds a needle holds every two- and three-character piece of it.
The index keeps, for each piece, the rows that have it, as sorted lists cut by
blocks of ``BLOCK`` row numbers; a search reads the lists of its rarest pieces,
intersects them block by block and confirms what is left on the texts
themselves, so its hits are those of the full scan for every needle of two
characters or more.

Scale. A list of a piece that all rows have is as many bounded blocks as the
rows need, dealt by (piece, block), so no key is hot and no list is ever whole
in one place. Lists are sorted by piece and rows by number: a search opens only
the row groups that can hold its pieces and its candidates. The pieces are found in
slices of rows that are dealt out by row number, whatever the files of the table
are, to as many tasks as the bytes of text need; a slice gives each of its pieces
one list, so the shuffle moves lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
RAREST = 4  # lists that are intersected; the confirmation makes the result exact whatever the number
DEALT_BITS = 12  # so many consecutive rows, as a power of two, go to one task (fewer if their texts are long)
_TASK = 8 << 20  # bytes of text whose pieces a task finds, about
_SLICE = 1 << 20  # bytes of text whose pieces are sorted at once (one row at least)
_PUSHED = 1000  # candidate blocks up to which the scan of the rows is told them


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = b.column("texts")
    of_row = np.bincount(pc.list_parent_indices(texts).to_numpy(), pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(), b.num_rows)
    part = (np.cumsum(of_row) / _SLICE).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z > a:
            yield b.slice(a, z - a)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, _block and the sorted places in the block of the rows that have it, from slices of (_id, texts)."""
    for b in (part for whole in batches for part in _slices(whole)):
        b = b.take(pc.sort_indices(b.column("_id")))
        ids = b.column("_id").to_numpy()
        flat = pc.fill_null(b.column("texts").flatten(), "")
        size = pc.utf8_length(flat).to_numpy()
        chars = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le"), np.uint32)
        row = np.repeat(pc.list_parent_indices(b.column("texts")).to_numpy().astype(np.int64), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # characters from here to the end of the text
        alphabet, code = np.unique(chars, return_inverse=True)
        code = code.astype(np.int64) + 1  # 0: no third character
        bits, row_bits = len(alphabet).bit_length(), len(ids).bit_length()
        two, three = np.flatnonzero(left >= 2), np.flatnonzero(left >= 3)
        key = np.concatenate([(code[two] << 2 * bits) | (code[two + 1] << bits), (code[three] << 2 * bits) | (code[three + 1] << bits) | code[three + 2]])
        if not len(key):
            continue
        known = None
        if 3 * bits + row_bits > 63:
            known, key = np.unique(key, return_inverse=True)
        pair = np.unique((key.astype(np.int64) << row_bits) | np.concatenate([row[two], row[three]]))
        key, own = pair >> row_bits, ids[pair & ((1 << row_bits) - 1)]
        block = own >> BLOCK_BITS
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        names = key[first] if known is None else known[key[first]]
        letters, mask = ["", *[chr(c) for c in alphabet.tolist()]], (1 << bits) - 1
        texts = [letters[n >> 2 * bits] + letters[n >> bits & mask] + letters[n & mask] for n in names.tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array((own & (BLOCK - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(block[first]), lists], names=["gram", "_block", "ids"])


def dealt(stored: DataFrame, strings: str) -> DataFrame:
    """_id and texts of numbered rows, in tasks of about ``_TASK`` bytes of text.

    The number of tasks is given, as the planner would join partitions by their
    compressed bytes until few tasks have all of the work.
    """
    rows = stored.select("_id", F.col(strings).cast("array<string>").alias("texts"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length(F.concat_ws("", "texts")).cast("long"))).first()
    size = size or 0
    bits = max(0, min(DEALT_BITS, (_SLICE * n // max(1, size)).bit_length() - 1))  # dealt together: a slice at most
    tasks = max(size // _TASK + 1, min(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), (n >> bits) + 1))
    return rows.repartition(tasks, F.shiftright("_id", bits))


def posting_lists(stored: DataFrame, strings: str) -> DataFrame:
    """gram, _block and ids (sorted places in the block) from numbered rows."""
    parts = dealt(stored, strings).mapInArrow(_pieces, "gram string, _block long, ids array<int>")
    return parts.groupBy("gram", "_block").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))


def build_gram_index(rows: DataFrame, strings: str, path: str) -> None:
    """Index the column ``strings`` (array of lower-case texts) of ``rows`` at the new folder ``path``."""
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()
    rows.withColumn("_id", number).withColumn("_block", F.shiftright("_id", BLOCK_BITS)).write.parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")  # numbers are fixed from here on
    lists = posting_lists(stored, strings)
    lists = lists.withColumn("n", F.size("ids"))
    lists.repartitionByRange("gram", "_block").sortWithinPartitions("gram", "_block").write.parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """(_block, _id) of the rows that have the rarest pieces of ``needle`` (lower case, two characters at least)."""
    size = 2 if len(needle) == 2 else 3
    pieces = sorted({needle[i : i + size] for i in range(len(needle) - size + 1)})
    known = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(pieces)).collect()  # one row for each piece of the needle
    lists = spark.read.parquet(f"{path}/postings")
    none = lists.where(F.lit(False))
    if len(known) == len(pieces):
        chosen = [r["gram"] for r in sorted(known, key=lambda r: (r["n"], r["gram"]))[:RAREST]]
        # blocks that have all pieces; a group holds at most RAREST lists of BLOCK numbers
        held = lists.where(F.col("gram").isin(chosen)).groupBy("_block").agg(
            *[F.max(F.when(F.col("gram") == g, F.col("ids"))).alias(f"g{k}") for k, g in enumerate(chosen)])
        both = reduce(F.array_intersect, [F.col(f"g{k}") for k in range(len(chosen))])
        held = held.where(reduce(lambda a, b: a & b, [F.col(f"g{k}").isNotNull() for k in range(len(chosen))]))
        at = held.select("_block", F.explode(both).alias("at"))
    else:
        at = none.select("_block", F.lit(0).alias("at"))
    return at.select("_block", (F.shiftleft("_block", BLOCK_BITS) + F.col("at")).alias("_id"))


def search_grams(spark: SparkSession, path: str, strings: str, q: str | None) -> DataFrame:
    """Rows of the index with a text of ``strings`` that contains ``q`` (trimmed, any case, two characters at least)."""
    needle = (q or "").strip().lower()
    rows = spark.read.parquet(f"{path}/rows")
    if len(needle) < 2:
        return rows.where(F.lit(False)).drop("_id", "_block")
    found = candidates(spark, path, needle)
    blocks = [r["_block"] for r in found.select("_block").distinct().limit(_PUSHED + 1).collect()]
    if len(blocks) <= _PUSHED:  # tells the scan where to look; the join below decides alone
        rows = rows.where(F.col("_block").isin(blocks))
    hits = rows.join(found.select("_id"), "_id", "left_semi")
    return hits.where(F.exists(strings, lambda x: x.contains(needle))).drop("_id", "_block")

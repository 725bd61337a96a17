"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct word shingles (hashed to 64 bits); its
sketch is the ``k`` least of them. Equal sets are one class, so exact copies,
however many, cost one row. The steps on classes:

1. Inverted lists of retained values. A pair over the threshold shares at least
   ``least`` of its retained values (``k`` 40, similarity 0.85: fewer than 20
   with a chance below 1e-7; sets of up to ``k`` shingles: by arithmetic). Below
   0.85 ``least`` and ``deep_least`` are lowered to what the binomial tail allows. So
   only a class's ``size - least + 1`` rarest values need index rows: with that
   prefix the pair still meets in one list, while the values of passages that
   many documents share are the frequent ones and fall away. Classes left alone
   in all their lists have no partner.
2. The others are indexed again by a deeper sketch (``deep``, the whole set up
   to 512 shingles). Positions in the rarest-first order bound the overlap, so
   copies that differ too much are not paired though they share hundreds of
   values. Each list is linked to its most common class first: a group of n
   near copies costs n pairs, not n^2. The union-sketch overlap drops pairs far
   below the threshold, the full sets confirm the rest.
3. Components of those links. Lists that still hold two or more components give
   their pairs across components, filtered and confirmed alike; pairs inside a
   component change nothing. A pair is given by the lists of its first common
   values only. No pair over the threshold is lost by step 2.

Null, empty and white-space texts have empty sets and link with nothing; a text
of fewer words than a shingle is one shingle; a null doc_id takes part, its
component is the least id it reaches (null if none) and ``kept`` compares null
safely; equal rows are all returned; empty tables give no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm import store, tokens
from skyledger.llm.components import components

_ODD = np.array([0x9E3779B97F4A7C15 ^ (0xD1B54A32D192ED03 * k) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, 65)], np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (signed 64-bit) of each text."""
    t = tokens.tokenise(texts, tokens.white_table())
    hashes = tokens.word_hashes(t.words)[t.codes]
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(words, n)):
        rolled[: n - k] += tokens.mixed(hashes[k:] + _ODD[k]) * _ODD[k]
    rolled = tokens.mixed(rolled).view(np.int64)
    out = []
    for a, z in zip(t.starts[:-1].tolist(), t.starts[1:].tolist()):
        if z - a >= words:
            out.append(np.unique(rolled[a : z - words + 1]))
        elif z > a:  # the whole sequence, told apart from longer ones by its length
            whole = np.uint64(0)
            for k in range(z - a):
                whole = tokens.mixed(whole + hashes[a + k : a + k + 1])[0]
            out.append(tokens.mixed(np.array([whole], np.uint64) ^ np.uint64(z - a)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def sets(docs: DataFrame, words: int, keep: int | None) -> DataFrame:
    """doc_id, n_shingles, class (128-bit digest of the set, null if empty) and the ``keep`` least values (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in tokens.slices(batches, "text", 4 << 20):
            found = shingle_sets(b.column("text"), words)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            out = [b.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(digest, pa.binary()), _lists([s[:keep] for s in found])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_shingles", "class", "values"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_shingles long, class binary, values array<long>")


def _index(values: DataFrame, least: int, percent: int) -> DataFrame:
    """Index rows of classes (class, n, values): their rarest values, less those no other class has.

    ``at``: the value's place in the class's rarest-first order, from 1;
    ``alone``: how many of the class's values no other class has.
    """
    flat = values.select("class", "n", F.size("values").alias("size"), F.explode("values").alias("value"))
    counts = flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("class")
    shared = flat.join(counts, "value").withColumn("alone", F.col("size") - F.count("*").over(own))
    shared = shared.withColumn("at", F.col("alone") + F.row_number().over(own.orderBy("df", "value")))
    need = F.least(F.lit(least), F.ceil(F.lit(percent) * F.col("size") / 100))
    return shared.where(F.col("at") <= F.col("size") - need + 1).select("value", "class", "n", "size", "at", "alone")


def _with_earlier(index: DataFrame, values: int = 6) -> DataFrame:
    """Index rows with ``earlier``: the class's ``values`` values ahead of this one in rarest-first order.

    Two classes that have one of them in common meet in its list as well, with
    more room after it, so the lists behind it need not give the pair again.
    The first common value never has one: no pair is lost.
    """
    ahead = Window.partitionBy("class").orderBy("at").rowsBetween(-values, -1)
    return index.withColumn("earlier", F.collect_list("value").over(ahead))


def _possible(a: str, b: str, deep: int, deep_least: int, percent: int) -> Column:
    """Whether two index rows of a value can belong to a pair over the threshold."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = 1 + F.least(F.col(f"{a}.size") - F.col(f"{a}.at"), F.col(f"{b}.size") - F.col(f"{b}.at"))
    need = F.when(F.greatest(n, m) > deep, F.lit(deep_least)).otherwise(F.ceil(F.lit(percent) * (n + m) / (100 + percent)))
    # the first common value of a pair is the one with the most room after it
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (both >= need)


def _confirmed(pairs: DataFrame, sketches: DataFrame, full: DataFrame, least: int, percent: int, k: int) -> DataFrame:
    """The pairs (u, v: classes) whose full sets reach the similarity."""

    def sides(frame: DataFrame, values: DataFrame) -> DataFrame:
        return (frame.join(values.select(F.col("class").alias("u"), F.col("values").alias("a")), "u")
                .join(values.select(F.col("class").alias("v"), F.col("values").alias("b")), "v"))

    common = F.size(F.array_intersect("a", "b"))
    # the union's sketch is the k least values of both; the part of it that both sets have estimates the similarity
    joined = F.slice(F.array_sort(F.array_union("a", "b")), 1, k)
    held = sides(pairs, sketches).select("u", "v", joined.alias("joined"), F.array_intersect("a", "b").alias("both"))
    estimate = F.size(F.array_intersect("joined", "both"))
    near = held.where(estimate >= F.least(F.lit(least), F.ceil(F.lit(percent) * F.size("joined") / 100))).select("u", "v")
    joint = F.size("a") + F.size("b") - F.col("common")
    return sides(near, full).withColumn("common", common).where(100 * F.col("common") >= percent * joint).select("u", "v")


def _shared(k: int, percent: int, chance: float) -> int:
    """The most ``m`` for which fewer than ``m`` of ``k`` values are shared, each with the similarity, with a chance below ``chance``."""
    s, tail = percent / 100, 0.0
    for m in range(k):
        tail += comb(k, m) * s**m * (1 - s) ** (k - m)
        if tail >= chance:
            return m
    return k


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, k: int = 40, least: int = 20,
                    deep: int = 512, deep_least: int = 386) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    if percent < 80 or words < 5:
        raise ValueError("takes shingles of five words or more and 80 percent or more")
    least, deep_least = min(least, _shared(k, percent, 1e-7)), min(deep_least, _shared(deep, percent, 1e-8))
    rows = store.written(sets(docs, words, k), "sketches")
    classes = store.written(rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("values").alias("values")), "classes")

    # 1. classes that share a rare retained value with another class, and their whole sets
    involved = _index(classes, least, percent).select("class").distinct()
    sketches = store.written(classes.join(involved, "class"), "involved")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(sketches.select("first_id").distinct(), texts["doc_id"].eqNullSafe(F.col("first_id")), "left_semi")
    full = sets(texts, words, None).join(sketches.select("class"), "class").dropDuplicates(["class"])
    full = store.written(full.select("class", F.col("n_shingles").alias("n"), "values"), "sets")

    # 2. the deeper index; each list against the class with the fewest values of its own
    index = store.written(_index(full.withColumn("values", F.slice("values", 1, deep)), deep_least, percent), "index")
    head = index.groupBy("value").agg(F.min(F.struct("alone", "class", "n", "size", "at")).alias("head")).select("value", "head.*")
    star = (index.alias("a").join(head.alias("b"), F.col("a.value") == F.col("b.value"))
            .where((F.col("a.class") != F.col("b.class")) & _possible("a", "b", deep, deep_least, percent))
            .select(F.least("a.class", "b.class").alias("u"), F.greatest("a.class", "b.class").alias("v")).distinct())
    star = store.written(star, "star")
    links = store.written(_confirmed(star, sketches, full, least, percent, k), "links")

    # 3. what lies across components
    roots = components(links)
    placed = index.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    several = placed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("value")
    placed = _with_earlier(placed.join(several, "value"))
    met = F.arrays_overlap("a.earlier", "b.earlier")
    across = (placed.alias("a").join(placed.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.root") < F.col("b.root")) & _possible("a", "b", deep, deep_least, percent) & ~met)
              .select(F.least("a.class", "b.class").alias("u"), F.greatest("a.class", "b.class").alias("v")).distinct()
              .join(star, ["u", "v"], "left_anti"))
    more = store.written(_confirmed(store.written(across, "across"), sketches, full, least, percent, k), "links")
    roots = components(links.union(more))

    named = classes.select("class", "first_id").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least_id = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least_id, "root").select("class", "component_id")
    out = rows.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))

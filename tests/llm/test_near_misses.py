"""op7: texts that share much but not enough are paired once, not in every list they share."""

import random

from pyspark.sql import functions as F

from skyledger.llm import near_dedup as N


def _family(rnd, members: int, words: int):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rnd.random() > 0.02 else f"x{rnd.randrange(10**6)}" for w in base) for _ in range(members)]


def test_near_misses_are_paired_once(spark):
    rnd = random.Random(7)
    texts = [t for _ in range(3) for t in _family(rnd, 12, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = N.sets(docs, 5, None).select("class", F.col("n_shingles").alias("n"), F.slice("values", 1, 512).alias("values"))
    index = N._index(full, 386, 85).localCheckpoint()

    def pairs(frame, more=F.lit(True)):
        a, b = frame.alias("a"), frame.alias("b")
        met = (F.col("a.value") == F.col("b.value")) & (F.col("a.class") < F.col("b.class")) & N._possible("a", "b", 512, 386, 85)
        return [(r[0], r[1]) for r in a.join(b, met & more).select("a.class", "b.class").collect()]

    every = pairs(index)
    once = pairs(N._with_earlier(index), ~F.arrays_overlap("a.earlier", "b.earlier"))
    assert set(every) == set(once) and len(set(every)) > 50
    assert len(every) > 10 * len(set(every)) and len(once) < 2 * len(set(once))


def test_links_between_near_misses_are_kept(spark):
    """Two families of near misses, some of whose members have a copy that reaches the threshold: brute force."""
    rnd = random.Random(8)
    texts = []
    for t in _family(rnd, 8, 300) + _family(rnd, 8, 700):
        texts.append(t)
        if rnd.random() < 0.5:
            w = t.split(" ")
            for _ in range(rnd.randint(1, 12)):
                w[rnd.randrange(len(w))] = f"y{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: find(k) for k in range(len(texts))}

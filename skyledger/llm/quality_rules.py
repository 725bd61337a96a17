"""Quality rules: repetition counts and divergence from language references.

A text fails when it is short or repetitive (the base rules), or when its
character classes, or classes and common words together, are far from every
reference language by Jensen-Shannon distance (base 2, 0 to 1). Each distance
has a guard: a histogram with few entries is not judged.

Everything is an expression over one row, JVM side: no shuffle, no skew, no
state beyond the row. Repeated three-word windows are found by sorting the row's
window hashes with their positions, so a text of any length is n log n.

Null and empty texts have no words and fail as short; equal rows are judged
each; lang and source are not read; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shares of the characters of words in ordinary prose, by language:
#: a e i o u, other letters, A-Z, digits, # * $ % & | < >, other ASCII marks.
CLASSES = {
    "en": (0.365, 0.585, 0.025, 0.003, 0.000, 0.022),
    "de": (0.345, 0.585, 0.045, 0.003, 0.000, 0.022),
    "fr": (0.400, 0.550, 0.025, 0.003, 0.000, 0.022),
    "es": (0.420, 0.530, 0.025, 0.003, 0.000, 0.022),
}

#: Common words and their shares of all words of prose, by language.
COMMON = {
    "en": {"the": 0.060, "of": 0.035, "and": 0.028, "to": 0.026, "in": 0.022, "a": 0.021, "is": 0.011, "that": 0.011, "for": 0.009},
    "de": {"der": 0.033, "die": 0.032, "und": 0.028, "in": 0.018, "den": 0.013, "das": 0.012, "mit": 0.010, "von": 0.010, "zu": 0.010},
    "fr": {"de": 0.055, "la": 0.033, "le": 0.027, "et": 0.024, "les": 0.021, "des": 0.017, "un": 0.012, "pour": 0.008, "que": 0.010},
    "es": {"de": 0.060, "la": 0.036, "que": 0.031, "el": 0.027, "en": 0.025, "y": 0.026, "los": 0.016, "se": 0.012, "con": 0.010},
}

LAST = "\U0010ffff"
WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_CHARS, MAX_CLASS_DISTANCE = 200, 0.25
MIN_COMMON, MAX_SUMMED_DISTANCE = 50, 0.5


def _distance(counts: Column, total: Column, shares: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram from fixed shares."""

    def term(count: Column, q: Column) -> Column:
        p = count / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(counts, F.array(*[F.lit(float(x)) for x in shares]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _count(text: Column, marks: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{marks}]+", ""))


def measures(docs: DataFrame) -> DataFrame:
    """The counts of each text, its class counts and its counts of common words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = sorted({x for shares in COMMON.values() for x in shares})
    words = docs.select("doc_id", text.alias("text"), F.filter(F.split(text, WHITE), lambda w: w != "").alias("words"),
                        F.regexp_replace(text, "[^!-`{-~]+", "").alias("rest"))  # capitals, digits and marks
    n, w = F.size("words"), F.col("words")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    # 33 bits of a window's hash above its position: equal windows are neighbours once sorted
    packed = F.transform(starts, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("long")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    vowels = sum((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(v), F.lit(""))) for v in "aeiou"), F.lit(0))
    step = words.select(
        "doc_id", "words", n.cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("rest"), r"#*$%&|<>").cast("long").alias("n_symbols"), vowels.alias("vowels"),
        _count(F.col("rest"), "A-Z").alias("upper"), _count(F.col("rest"), "0-9").alias("digits"), F.char_length("rest").alias("rest"),
        lines.alias("lines"), F.sort_array(packed).alias("packed"),
        # each common word once more than it occurs, sorted: a word's count is the room up to the next one
        F.sort_array(F.concat(F.filter("words", lambda x: x.isin(every)), F.array(*map(F.lit, every)), F.array(F.lit(LAST)))).alias("common"))
    s, c = F.col("packed"), F.col("again")
    same = lambda x, y: F.coalesce(F.shiftright(x, 31) == F.shiftright(y, 31), F.lit(False))
    twice = F.filter("packed", lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
    place = F.transform(F.array(*map(F.lit, [*every, LAST])), lambda x: F.array_position("common", x))
    letters = F.col("word_chars") - F.col("vowels") - F.col("rest")
    marks = F.col("rest") - F.col("upper") - F.col("digits") - F.col("n_symbols")
    step = step.select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.array("vowels", letters, "upper", "digits", "n_symbols", marks).alias("classes"), place.alias("place"), "words",
                       F.transform(twice, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("again"))
    # the words themselves decide
    spelled = F.sort_array(F.transform("again", lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p"))))
    step = step.withColumn("again", spelled)
    alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    found = F.filter("again", lambda x, j: alike(x, F.get(c, j - 1)) | alike(x, F.get(c, j + 1)))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(every) - 1)), lambda i: F.get("place", i + 1) - F.get("place", i) - 1)
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"), "classes", counts.alias("counts"))


def judge(docs: DataFrame) -> DataFrame:
    """The measures of each text, both distances (null below their guard), ``base_failed`` and ``kept``."""
    every = sorted({x for shares in COMMON.values() for x in shares})
    n = F.col("n_words")
    class_distance = F.least(*[_distance(F.col("classes"), F.col("word_chars"), list(x)) for x in CLASSES.values()])
    near = []
    for shares in COMMON.values():
        own = F.transform(F.array(*[F.lit(every.index(w)) for w in shares]), lambda i: F.get("counts", i))
        own = F.concat(own, F.array(n - F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)))
        near.append(_distance(own, n, [*shares.values(), 1.0 - math.fsum(shares.values())]))
    common_distance = F.when(n >= MIN_COMMON, F.least(*near))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = (F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(F.col("class_distance") + F.col("common_distance") > MAX_SUMMED_DISTANCE, F.lit(False)))
    return (measures(docs)
            .withColumn("class_distance", F.when(F.col("word_chars") >= MIN_CHARS, class_distance))
            .withColumn("common_distance", common_distance)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~far).alias("kept"), "class_distance", "common_distance"))

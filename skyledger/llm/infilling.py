"""Fill-in-the-middle texts, cut by a piecewise-linear learned rank index.

Cuts are numbers of code points; a text is UTF-8 bytes. The index answers "at
which byte does code point r start": the boundary offsets of all code points of
a slice of texts, a rising sequence, are covered by straight segments. A
segment is the line through its first and last boundary; where some boundary
lies further from the line than ``error``, the segment is halved. What the line
misses by is stored for every boundary as a residual of one byte. A cut is
predicted by its segment's line, and the residual makes it exact: one look-up in
the short list of segments, whatever the text's length. Plain ASCII is one
segment; the index takes a byte a code point, against eight of the offsets.

``transform`` keeps its general form (rates, markers, seed); ``restore`` is the
inverse as a column expression.

Scale. No shuffle: a row's form and cuts are hashes of its doc_id. Texts go
through Python in slices of 1 MB (a longer text is indexed in blocks of 1 MB).

Null texts are empty, empty ones and such with a marker inside stay plain; a
null doc_id hashes as no digits; equal rows are each transformed alike; further
columns are ignored, whatever their names; empty tables give no rows; very long
texts are cut whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import tokens

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_BLOCK = 1 << 20


class RankIndex(NamedTuple):
    """Segments of boundary offsets: ``first`` rank, its ``base`` offset, and the line's ``rise`` over ``run``."""

    first: np.ndarray
    base: np.ndarray
    rise: np.ndarray
    run: np.ndarray
    residual: np.ndarray  # int8, one for each boundary

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The byte at which each of ``ranks`` starts."""
        s = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[s] + (ranks - self.first[s]) * self.rise[s] // self.run[s] + self.residual[ranks]


def boundaries(data: np.ndarray) -> np.ndarray:
    """The bytes of ``data`` (UTF-8) at which a code point starts."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def fitted(offsets: np.ndarray, error: int = 127) -> tuple[np.ndarray, np.ndarray]:
    """First places of segments whose lines miss none of ``offsets`` by more than ``error``, and what they miss by.

    ``offsets`` rise. Every round looks at all open segments at once; a segment
    that misses is halved, so there are at most log2 rounds.
    """
    last = len(offsets) - 1
    missed = np.zeros(last + 1, np.int8)
    done, a, z = [np.zeros(0, np.int64)], np.array([0]), np.array([last])
    while len(a):
        size = z - a  # a segment covers its places from a to z - 1 (the last one also z)
        place = tokens.gathered(np.arange(last + 1), a, size + (z == last))
        count = size + (z == last)
        line = np.repeat(offsets[a], count)
        line += (place - np.repeat(a, count)) * np.repeat(offsets[z] - offsets[a], count) // np.repeat(np.maximum(size, 1), count)
        off = offsets[place] - line
        most = np.maximum.reduceat(np.abs(off), np.cumsum(count) - count)
        good = (most <= error) | (size <= 1)
        kept = np.repeat(good, count)
        missed[place[kept]] = off[kept]
        done.append(a[good])
        a, z = a[~good], z[~good]
        half = (a + z) // 2
        a, z = np.concatenate([a, half]), np.concatenate([half, z])
        order = np.argsort(a)
        a, z = a[order], z[order]
    return np.sort(np.concatenate(done)), missed


def indexed(data: np.ndarray, error: int = 127) -> RankIndex:
    """The index of all code points of ``data`` and of its end, built block by block."""
    if not 0 <= error <= 127:
        raise ValueError(f"residuals are bytes: error lies in 0..127, not {error}")
    firsts, bases, rises, runs, residuals, rank = [], [], [], [], [], 0
    for at in range(0, max(len(data), 1), _BLOCK):
        own = boundaries(data[at : at + _BLOCK]) + at
        if at + _BLOCK >= len(data):
            own = np.append(own, len(data))
        if not len(own):
            continue
        first, missed = fitted(own, error)
        to = np.append(first[1:], len(own) - 1)
        firsts.append(first + rank)
        bases.append(own[first])
        rises.append(own[to] - own[first])
        runs.append(np.maximum(to - first, 1))
        residuals.append(missed)
        rank += len(own)
    return RankIndex(*(np.concatenate(x) for x in (firsts, bases, rises, runs, residuals)))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32: the first 8-digit groups of the hex SHA-256 of ``seed:doc_id``."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, error: int = 127) -> DataFrame:
    """Each row's text as fill-in-the-middle training text.

    The third draw modulo 100 at ``plain_from`` or above leaves a text plain, the
    fourth below ``spm_below`` puts the suffix first. Returns doc_id, n (code
    points), form, prefix_chars and middle_chars (null if plain) and output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
        for b in tokens.slices(batches, "text", _BLOCK):
            data, starts = tokens.raw(b.column("text"))
            index = indexed(data, error)
            # ranks of the texts' starts: the code points before them
            leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
            n = np.diff(leads)
            h = [b.column(f"h{k}").to_numpy() for k in range(1, 5)]
            one, two = h[0] % (n + 1), h[1] % (n + 1)
            low, high = np.minimum(one, two), np.maximum(one, two)
            cuts = index.offsets(np.concatenate([leads[:-1] + low, leads[:-1] + high])).reshape(2, -1)
            view, forms, outputs = memoryview(data), [], []
            for k, (a, p, m, z) in enumerate(zip(starts[:-1].tolist(), *cuts.tolist(), starts[1:].tolist())):
                text = bytes(view[a:z])
                if a == z or h[2][k] % 100 >= plain_from or any(x in text for x in marks):
                    forms.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = text[: p - a], text[p - a : m - a], text[m - a :]
                spm = h[3][k] % 100 < spm_below
                forms.append("spm" if spm else "psm")
                lead = marks[1] + suffix + marks[0] + prefix if spm else marks[0] + prefix + marks[1] + suffix
                outputs.append(lead + marks[2] + middle)
            plain = np.array([f == "plain" for f in forms])
            out = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms), pa.array(low, pa.int64(), mask=plain),
                   pa.array(high - low, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = own.select("*", *(h.alias(f"h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed), 1)))
    return drawn.mapInArrow(run, COLUMNS)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # the first part lies before the first marker
    first, second, third = (F.get(part, F.lit(k)) for k in (1, 2, 3))
    psm, spm = F.concat(first, third, second), F.concat(second, third, first)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(transformed: DataFrame) -> DataFrame:
    """``transformed`` with the SHA-256 of the outputs and of the texts rebuilt from them in place of the outputs."""
    rebuilt = restore(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                              F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


SQL = f"""
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbered AS (
    SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM drawn
), cut AS (
    SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
           CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbered
), parts AS (
    SELECT doc_id, t, n, form, low, high, substr(t, 1, low) AS p, substr(t, low + 1, high - low) AS m, substr(t, high + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

"""Bounded samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(frame: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, those with the least hashes of ``key``: the same ones whatever the partitioning.

    The threshold is found on the hashes alone, so the driver sees one number.
    """
    mark = F.xxhash64(F.col(key))
    least = frame.select(mark.alias("h")).orderBy("h").limit(rows).agg({"h": "max"}).first()[0]
    return frame.where(mark <= (least if least is not None else 0)).limit(rows)

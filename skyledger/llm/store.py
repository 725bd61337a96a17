"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from skyledger.session import scratch_path


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage, as ``checkpoint()`` does, but computes the rows once. The
    files outlive lost executors; each call takes a folder of its own.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)

"""Data-quality checks replacing the reference's database constraints
(unique natural keys, at most one running run per collector) and the
catalog's name-field conformance report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import field_type, truthy
from skyledger.operators.unify import Service


def unique_key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1))


def running_run_violations(runs: DataFrame) -> DataFrame:
    """Collectors with more than one run in state ``running``."""
    return (runs.groupBy("collector_name")
            .agg(F.count_if(F.col("status") == "running").alias("running"))
            .filter(F.col("running") > 1))


def field_conformance(catalog: list[Service]) -> DataFrame:
    """Per service: whether its declared name field exists, and how many rows
    carry a truthy value in it (the rest fall back to name / id / Unknown)."""
    out = None
    for s in catalog:
        present = s.name_field is not None and field_type(s.df, s.name_field) is not None
        named = truthy(s.df, s.name_field) if present else F.lit(False)
        part = s.df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(named).alias("named_rows")).select(
            F.lit(s.provider).alias("provider"), F.lit(s.key).alias("service"),
            F.lit(s.name_field).cast("string").alias("name_field"), F.lit(present).alias("field_present"),
            "rows", "named_rows")
        out = part if out is None else out.unionByName(part)
    return out

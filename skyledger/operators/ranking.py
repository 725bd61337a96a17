"""Pages by rank (O3): any page of a sorted view without sorting or skipping rows again.

``build_rank_index`` sorts a frame once by a page order and keeps it in ranges
of that order: a folder for each range, its rows numbered from 0, and a table
with each range's first global rank and row count (the prefix sums of the
counts). Page n is then the rows of the one or two ranges that hold its ranks;
the folder of a range and the rank filter reach the scan, so page 200,000 costs
what page 1 costs.

Rows are dealt to ranges by the whole order. Give it a last column without ties
(the input ordinal): a sort value that a third of the rows share is then cut
into as many ranges as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE, RANK = "_range", "_rank"
_ROW = (1 << 33) - 1  # the row part of monotonically_increasing_id


def build_rank_index(df: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
    """Write ``df`` in the order ``order`` (for example ``views.smart_order``) as a rank index at ``path``.

    Use about a million rows a range. ``path`` must be new; the range table is
    written last, so an index without it is not complete.
    """
    df.limit(0).write.parquet(f"{path}/columns")  # the schema, also of an index without rows
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *order)
    rows = rows.withColumn(RANK, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW)))
    rows.write.partitionBy(RANGE).parquet(f"{path}/rows")
    # counted from the files' footers; one row for each range
    counts = df.sparkSession.read.schema(f"{RANGE} INT").parquet(f"{path}/rows").groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(RANGE))
    counts.select(RANGE, (upto - F.col("n")).alias("first"), "n").coalesce(1).write.parquet(f"{path}/ranges")


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RANGE} INT, first LONG, n LONG").parquet(f"{path}/ranges")


def rank_summary(spark: SparkSession, path: str, page_no: int, rows: int) -> DataFrame:
    """O4 from the range table alone: from, to, total and page count of a page."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    per = F.col("total") if rows == -1 else F.lit(rows)
    start = F.lit(0) if rows == -1 else F.lit(page_no * rows)
    return _ranges(spark, path).agg(total.alias("total")).select(
        F.when(F.col("total") > 0, start + 1).otherwise(F.lit(0)).cast("long").alias("from_row"),
        F.least(start + per, F.col("total")).cast("long").alias("to_row"), F.col("total").cast("long").alias("total"),
        (F.lit(1) if rows == -1 else F.greatest(F.ceil(F.col("total") / F.lit(rows)), F.lit(1))).cast("long").alias("pages"))


def page_by_rank(spark: SparkSession, path: str, page_no: int, rows: int, position: str | None = None) -> DataFrame:
    """Page ``page_no`` of the index, equal to ``views.page`` in its order; rows=-1 is everything.

    ``position``: a column with the row's 1-based place in the whole order.
    """
    if page_no < 0 or rows < -1 or rows == 0:
        raise ValueError("a page has a number from 0 and rows from 1 (or -1)")
    start, end = (0, None) if rows == -1 else (page_no * rows, page_no * rows + rows)
    table = _ranges(spark, path)
    columns = spark.read.parquet(f"{path}/columns").schema
    stored = spark.read.schema(T.StructType([*columns.fields, T.StructField(RANK, T.LongType()), T.StructField(RANGE, T.IntegerType())])).parquet(f"{path}/rows")
    if end is None:
        out = stored.join(F.broadcast(table.select(F.col(RANGE).alias("_r"), "first")), F.col(RANGE) == F.col("_r"))
    else:
        # a range that meets the page holds one of its rows at least, so these are no more than the page has rows
        met = table.where((F.col("first") < end) & (F.col("first") + F.col("n") > start) & (F.col("n") > 0)).collect()
        within, first = F.lit(False), F.lit(None).cast("long")
        for r in met:
            own = F.col(RANGE) == r[RANGE]
            within = within | (own & F.col(RANK).between(max(0, start - r["first"]), min(r["n"], end - r["first"]) - 1))
            first = F.when(own, F.lit(r["first"])).otherwise(first)
        out = stored.where(F.col(RANGE).isin([r[RANGE] for r in met]) & within).withColumn("first", first)
    shown = [F.col(f"`{c}`") for c in columns.names]
    if position:
        shown.append((F.col("first") + F.col(RANK) + 1).alias(position))
    out = out.orderBy(RANGE, RANK)
    return (out if end is None else out.limit(rows)).select(*shown)

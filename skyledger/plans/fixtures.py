"""Inventory inputs derived from the benchmark tables.

The benchmark tables hold no assets, so every operator runs on a fixed
derivation of them (whole tables, fixed ``as_of`` / ``now``; never the clock).
Each derivation has a SQL twin next to its queries in ``plans.*_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the derivations format dates and times; pin the zone so results do not
    # depend on the caller's session
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finalize(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text so both engines print them alike."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- M1: domains from orders --------------------------------------------------
DOM_AS_OF = "2001-08-02"
DOM_NOW = "2001-08-02 00:00:00"
DOM_SOURCE = "1-URGENT"


def domain_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, one row per (customer, priority): every order but the
    batch's from 1999 on, so each order is in the snapshot, the batch or both."""
    o = table(spark, sf_dir, "orders").filter(
        ~((F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
          & (F.col("o_orderpriority") == DOM_SOURCE)))
    # group on the numeric key, build the text key after the aggregation
    g = o.groupBy("o_custkey", F.col("o_orderpriority").alias("registrar")).agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"),
        F.count(F.lit(1)).alias("n"))
    return g.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("domain"), "registrar",
        F.when(F.col("last") < F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("removed"))
        .otherwise(F.lit("active")).alias("status"),
        F.date_add(F.to_date("last"), 365).alias("expiry_date"),
        F.to_date("first").alias("discovery_date"),
        F.to_date("last").alias("last_seen"),
        F.to_json(F.struct(F.col("n"))).alias("raw_data"),
        F.to_date("first").cast("timestamp").alias("created_at"),
        F.to_date("last").cast("timestamp").alias("updated_at"))


def domain_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection of one registrar: its orders from 1998 on, in key order."""
    o = table(spark, sf_dir, "orders").filter(
        (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderpriority") == DOM_SOURCE))
    return o.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("domain"),
        F.date_add(F.to_date("o_orderdate"), 365).alias("expiry_date"),
        F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("raw_data"),
        F.col("o_orderkey").alias("_ordinal"))


# --- M2: DNS records from lineitem ---------------------------------------------
DNS_AS_OF = "2001-12-01"
DNS_NOW = "2001-12-01 00:00:00"
DNS_SOURCE = "F"


def _dns_key_cols():
    return [F.col("l_orderkey").cast("string").alias("domain"),
            F.col("l_linenumber").cast("string").alias("subdomain"),
            F.col("l_returnflag").alias("record_type"),
            F.col("l_partkey").cast("string").alias("data"),
            F.col("l_linestatus").alias("source")]


def dns_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item but the batch's from 2000 on, so each one is in the
    snapshot, the batch or both."""
    li = table(spark, sf_dir, "lineitem").filter(
        ~((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
          & (F.col("l_linestatus") == DNS_SOURCE)))
    # group on the native key columns (text keys are built after the aggregation)
    g = li.groupBy("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_linestatus").agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
        F.max("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select(
        *_dns_key_cols()[:4],
        F.col("q").cast("int").alias("ttl"), F.col("n").cast("int").alias("priority"),
        F.col("l_linestatus").alias("source"),
        F.when(F.col("last") < F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("removed"))
        .otherwise(F.lit("active")).alias("status"),
        F.to_date("first").alias("discovery_date"),
        F.to_date("last").alias("last_seen"),
        F.to_json(F.struct(F.col("n"))).alias("raw_data"),
        F.to_date("first").cast("timestamp").alias("created_at"),
        F.to_date("last").cast("timestamp").alias("updated_at"))


def dns_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(
        (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz"))
        & (F.col("l_linestatus") == DNS_SOURCE))
    k = _dns_key_cols()
    return li.select(
        *k[:4],
        F.col("l_quantity").cast("int").alias("ttl"),
        F.col("l_linenumber").alias("priority"),
        F.to_json(F.struct("l_orderkey", "l_suppkey")).alias("raw_data"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("_ordinal"))

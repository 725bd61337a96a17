"""Registered merge queries (M1-M6, J1, J2, N6) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import merge as M
from skyledger.operators import views as V
from skyledger.plans import fixtures as X


def _dom(spark, sf):
    return M.merge_domains(X.domain_snapshot(spark, sf), X.domain_batch(spark, sf),
                           X.DOM_SOURCE, X.DOM_AS_OF, X.DOM_NOW)


def _dns(spark, sf):
    return M.merge_dns_records(X.dns_snapshot(spark, sf), X.dns_batch(spark, sf),
                               X.DNS_SOURCE, X.DNS_AS_OF, X.DNS_NOW)


def m1_merge_domains(spark: SparkSession, sf: str) -> DataFrame:
    return X.finalize(_dom(spark, sf).snapshot)


def m2_merge_dns_records(spark: SparkSession, sf: str) -> DataFrame:
    return X.finalize(_dns(spark, sf).snapshot)


def m3_merge_stats_domains(spark, sf):
    return _dom(spark, sf).stats


def m3_merge_stats_dns(spark, sf):
    return _dns(spark, sf).stats


def m4_change_log_domains(spark, sf):
    return _dom(spark, sf).changes


def m4_change_log_dns(spark, sf):
    return _dns(spark, sf).changes


def a1_kept_counts(spark, sf):
    """Status counts per registrar after a merge, from those before it and its change log."""
    before = X.domain_snapshot(spark, sf)
    merged = _dom(spark, sf)
    counts = V.status_stats(before, ["registrar"])
    return M.kept_counts(counts, M.change_log(merged), ["registrar"])


def m5_batch_last_wins(spark, sf):
    b = X.domain_batch(spark, sf).withColumn("registrar", F.lit(X.DOM_SOURCE))
    return X.finalize(M.dedupe_last(b, ["domain", "registrar"], "_ordinal", "batch_rows"))


def m6_run_sync(spark, sf):
    """``run_sync`` twice: with both batches, and with an empty record batch
    (its merge is skipped, so no record is removed). The domain snapshot's
    registrar takes the name of the record source."""
    doms = X.domain_snapshot(spark, sf).withColumn(
        "registrar", F.when(F.col("registrar") == X.DOM_SOURCE, F.lit(X.DNS_SOURCE)).otherwise(F.col("registrar")))
    recs, batch = X.dns_snapshot(spark, sf), X.dns_batch(spark, sf)
    out = None
    for name, records in (("both", batch), ("no_records", batch.limit(0))):
        r = M.run_sync(doms, recs, X.domain_batch(spark, sf), records, X.DNS_SOURCE, X.DNS_AS_OF, X.DNS_NOW)
        removed = r.records.agg(F.count_if(F.col("status") == "removed").alias("removed_records"))
        part = M.combine_rows([r.stats, removed], ["records_found", "added", "updated", "removed", "reactivated",
                                                   "removed_records"]).withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def j1_match_batch(spark, sf):
    s = X.dns_snapshot(spark, sf).filter(F.col("source") == X.DNS_SOURCE)
    b = X.dns_batch(spark, sf).withColumn("source", F.lit(X.DNS_SOURCE))
    m = M.match_batch(s, b, ["domain", "subdomain", "record_type", "data", "source"])
    return m.groupBy("in_snapshot", "in_batch").agg(F.count(F.lit(1)).alias("n"))


def j2_scope_to_batch(spark, sf):
    s = X.dns_snapshot(spark, sf).filter(F.col("source") == X.DNS_SOURCE)
    scoped = M.scope_to_batch(s, X.dns_batch(spark, sf))
    return scoped.groupBy("_scope", "status").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(
        "_scope", "in_scope")


def n6_collection_stats(spark, sf):
    return M.collection_stats(X.domain_batch(spark, sf), X.dns_batch(spark, sf),
                              "2001-12-01 06:00:00", "2001-12-01 06:12:30")


QUERIES = {
    "a1_kept_counts": a1_kept_counts,
    "m1_merge_domains": m1_merge_domains,
    "m2_merge_dns_records": m2_merge_dns_records,
    "m3_merge_stats_domains": m3_merge_stats_domains,
    "m3_merge_stats_dns": m3_merge_stats_dns,
    "m4_change_log_domains": m4_change_log_domains,
    "m4_change_log_dns": m4_change_log_dns,
    "m5_batch_last_wins": m5_batch_last_wins,
    "m6_run_sync": m6_run_sync,
    "j1_match_batch": j1_match_batch,
    "j2_scope_to_batch": j2_scope_to_batch,
    "n6_collection_stats": n6_collection_stats,
}

# --- SQL twins ---------------------------------------------------------------
_DOM_CTE = """
s AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS registrar,
         CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(max(o_orderdate) AS DATE) + 365 AS expiry_date,
         CAST(min(o_orderdate) AS DATE) AS discovery_date,
         CAST(max(o_orderdate) AS DATE) AS last_seen,
         '{"n":' || CAST(count(*) AS VARCHAR) || '}' AS raw_data,
         CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP) AS created_at,
         CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP) AS updated_at
  FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2),
b AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, CAST(o_orderdate AS DATE) + 365 AS expiry_date,
         '{"o_orderkey":' || CAST(o_orderkey AS VARCHAR) || ',"o_orderstatus":"' || o_orderstatus || '"}' AS raw_data,
         o_orderkey AS ord
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT'),
bd AS (SELECT domain, arg_max(expiry_date, ord) AS expiry_date, arg_max(raw_data, ord) AS raw_data,
              count(*) AS n FROM b GROUP BY domain),
j AS (
  SELECT coalesce(s.domain, bd.domain) AS domain, '1-URGENT' AS registrar,
         s.domain IS NOT NULL AS in_s, bd.domain IS NOT NULL AS in_b, coalesce(bd.n, 0) AS n,
         s.status AS s_status, s.expiry_date AS s_expiry, s.discovery_date AS s_disc, s.last_seen AS s_last,
         s.raw_data AS s_raw, s.created_at AS s_created, s.updated_at AS s_updated,
         bd.expiry_date AS b_expiry, bd.raw_data AS b_raw
  FROM (SELECT * FROM s WHERE registrar = '1-URGENT') s FULL OUTER JOIN bd ON s.domain = bd.domain),
jf AS (SELECT *, (NOT in_b AND in_s AND s_status = 'active' AND s_last < DATE '2001-08-02') AS flip FROM j),
m AS (
  SELECT domain, registrar,
         CASE WHEN in_b THEN 'active' WHEN flip THEN 'removed' ELSE s_status END AS status,
         CASE WHEN in_b THEN b_expiry ELSE s_expiry END AS expiry_date,
         CASE WHEN in_s THEN s_disc ELSE DATE '2001-08-02' END AS discovery_date,
         CASE WHEN in_b THEN DATE '2001-08-02' ELSE s_last END AS last_seen,
         CASE WHEN in_b THEN b_raw ELSE s_raw END AS raw_data,
         CASE WHEN in_s THEN s_created ELSE TIMESTAMP '2001-08-02 00:00:00' END AS created_at,
         CASE WHEN in_b OR flip THEN TIMESTAMP '2001-08-02 00:00:00' ELSE s_updated END AS updated_at,
         CASE WHEN in_b AND NOT in_s THEN 'added' WHEN in_b AND s_status = 'removed' THEN 'reactivated'
              WHEN in_b THEN 'updated' WHEN flip THEN 'removed' ELSE 'unchanged' END AS change,
         n
  FROM jf)
"""

_DNS_CTE = """
s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS record_type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source,
         CAST(max(l_quantity) AS INTEGER) AS ttl, CAST(count(*) AS INTEGER) AS priority,
         CASE WHEN max(l_shipdate) < TIMESTAMP '1997-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(min(l_shipdate) AS DATE) AS discovery_date, CAST(max(l_shipdate) AS DATE) AS last_seen,
         '{"n":' || CAST(count(*) AS VARCHAR) || '}' AS raw_data,
         CAST(CAST(min(l_shipdate) AS DATE) AS TIMESTAMP) AS created_at,
         CAST(CAST(max(l_shipdate) AS DATE) AS TIMESTAMP) AS updated_at
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5),
b AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS record_type, CAST(l_partkey AS VARCHAR) AS data,
         CAST(l_quantity AS INTEGER) AS ttl, l_linenumber AS priority,
         '{"l_orderkey":' || CAST(l_orderkey AS VARCHAR) || ',"l_suppkey":' || CAST(l_suppkey AS VARCHAR) || '}' AS raw_data,
         (l_orderkey, l_linenumber, l_suppkey, l_quantity) AS ord
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_linestatus = 'F'),
bd AS (SELECT domain, subdomain, record_type, data, arg_max(ttl, ord) AS ttl, arg_max(priority, ord) AS priority,
              arg_max(raw_data, ord) AS raw_data, count(*) AS n
       FROM b GROUP BY domain, subdomain, record_type, data),
own AS (SELECT *, domain IN (SELECT domain FROM b) AS in_scope FROM s WHERE source = 'F'),
j AS (
  SELECT coalesce(own.domain, bd.domain) AS domain, coalesce(own.subdomain, bd.subdomain) AS subdomain,
         coalesce(own.record_type, bd.record_type) AS record_type, coalesce(own.data, bd.data) AS data,
         'F' AS source, own.domain IS NOT NULL AS in_s, bd.domain IS NOT NULL AS in_b, coalesce(bd.n, 0) AS n,
         coalesce(own.in_scope, false) AS in_scope,
         own.status AS s_status, own.ttl AS s_ttl, own.priority AS s_prio, own.discovery_date AS s_disc,
         own.last_seen AS s_last, own.raw_data AS s_raw, own.created_at AS s_created, own.updated_at AS s_updated,
         bd.ttl AS b_ttl, bd.priority AS b_prio, bd.raw_data AS b_raw
  FROM own FULL OUTER JOIN bd ON own.domain = bd.domain AND own.subdomain = bd.subdomain
       AND own.record_type = bd.record_type AND own.data = bd.data),
jf AS (SELECT *, (NOT in_b AND in_s AND in_scope AND s_status = 'active' AND s_last < DATE '2001-12-01') AS flip FROM j),
m AS (
  SELECT domain, subdomain, record_type, data,
         CASE WHEN in_b THEN b_ttl ELSE s_ttl END AS ttl,
         CASE WHEN in_b THEN b_prio ELSE s_prio END AS priority,
         source,
         CASE WHEN in_b THEN 'active' WHEN flip THEN 'removed' ELSE s_status END AS status,
         CASE WHEN in_s THEN s_disc ELSE DATE '2001-12-01' END AS discovery_date,
         CASE WHEN in_b THEN DATE '2001-12-01' ELSE s_last END AS last_seen,
         CASE WHEN in_b THEN b_raw ELSE s_raw END AS raw_data,
         CASE WHEN in_s THEN s_created ELSE TIMESTAMP '2001-12-01 00:00:00' END AS created_at,
         CASE WHEN in_b OR flip THEN TIMESTAMP '2001-12-01 00:00:00' ELSE s_updated END AS updated_at,
         CASE WHEN in_b AND NOT in_s THEN 'added' WHEN in_b AND s_status = 'removed' THEN 'reactivated'
              WHEN in_b THEN 'updated' WHEN flip THEN 'removed' ELSE 'unchanged' END AS change,
         n
  FROM jf)
"""

_D = "strftime({0}, '%Y-%m-%d') AS {0}"
_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

_STATS = """SELECT CAST(count(*) FILTER (WHERE change = 'added') AS BIGINT) AS added,
  CAST(sum(n) - count(*) FILTER (WHERE change = 'added') AS BIGINT) AS updated,
  CAST(count(*) FILTER (WHERE change = 'removed') AS BIGINT) AS removed,
  CAST(count(*) FILTER (WHERE change = 'reactivated') AS BIGINT) AS reactivated FROM m"""

SQL = {
    "m1_merge_domains": "WITH " + _DOM_CTE + f"""
SELECT domain, registrar, status, {_D.format('expiry_date')}, {_D.format('discovery_date')},
       {_D.format('last_seen')}, raw_data, {_T.format('created_at')}, {_T.format('updated_at')} FROM m
UNION ALL
SELECT domain, registrar, status, {_D.format('expiry_date')}, {_D.format('discovery_date')},
       {_D.format('last_seen')}, raw_data, {_T.format('created_at')}, {_T.format('updated_at')}
FROM s WHERE registrar <> '1-URGENT'""",
    "m2_merge_dns_records": "WITH " + _DNS_CTE + f"""
SELECT domain, subdomain, record_type, data, ttl, priority, source, status, {_D.format('discovery_date')},
       {_D.format('last_seen')}, raw_data, {_T.format('created_at')}, {_T.format('updated_at')} FROM m
UNION ALL
SELECT domain, subdomain, record_type, data, ttl, priority, source, status, {_D.format('discovery_date')},
       {_D.format('last_seen')}, raw_data, {_T.format('created_at')}, {_T.format('updated_at')}
FROM s WHERE source <> 'F'""",
    "m3_merge_stats_domains": "WITH " + _DOM_CTE + _STATS,
    "m3_merge_stats_dns": "WITH " + _DNS_CTE + _STATS,
    "m4_change_log_domains": "WITH " + _DOM_CTE + "SELECT domain, registrar, change FROM m",
    "m4_change_log_dns": "WITH " + _DNS_CTE + "SELECT domain, subdomain, record_type, data, source, change FROM m",
    "m5_batch_last_wins": "WITH " + _DOM_CTE.split("j AS (")[0].rstrip().rstrip(",") + """
SELECT domain, '1-URGENT' AS registrar, strftime(expiry_date, '%Y-%m-%d') AS expiry_date, raw_data,
       n AS batch_rows FROM bd""",
    "m6_run_sync": f"""
WITH d AS (WITH {_DOM_CTE.replace("2001-08-02", "2001-12-01")} {_STATS}), r AS (WITH {_DNS_CTE} {_STATS}),
nd AS (SELECT CAST(count(*) AS BIGINT) AS n FROM orders
       WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT'),
nr AS (SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_linestatus = 'F'),
new_removed AS (WITH {_DNS_CTE} SELECT (SELECT count(*) FROM m WHERE status = 'removed')
                + (SELECT count(*) FROM s WHERE source <> 'F' AND status = 'removed') AS n),
old_removed AS (WITH {_DNS_CTE} SELECT count(*) AS n FROM s WHERE status = 'removed')
SELECT 'both' AS run, nd.n + nr.n AS records_found, d.added + r.added AS added, d.updated + r.updated AS updated,
       d.removed + r.removed AS removed, d.reactivated + r.reactivated AS reactivated,
       CAST(new_removed.n AS BIGINT) AS removed_records FROM d, r, nd, nr, new_removed
UNION ALL
SELECT 'no_records', nd.n, d.added, d.updated, d.removed, d.reactivated, CAST(old_removed.n AS BIGINT)
FROM d, nd, old_removed""",
    "j1_match_batch": "WITH " + _DNS_CTE + """
SELECT in_s AS in_snapshot, in_b AS in_batch, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2""",
    "j2_scope_to_batch": "WITH " + _DNS_CTE + """
SELECT in_scope, status, CAST(count(*) AS BIGINT) AS n FROM own GROUP BY 1, 2""",
    "n6_collection_stats": """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
          AND o_orderpriority = '1-URGENT') AS domains_found,
       (SELECT CAST(count(*) AS BIGINT) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01'
          AND l_linestatus = 'F') AS records_found,
       CAST(750 AS BIGINT) AS duration_sec""",
}

SQL["a1_kept_counts"] = f"""SELECT registrar, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS active,
  CAST(count(*) FILTER (WHERE status = 'removed') AS BIGINT) AS removed FROM ({SQL['m1_merge_domains']}) GROUP BY registrar"""

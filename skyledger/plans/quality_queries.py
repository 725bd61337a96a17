"""Registered data-quality queries (D15, D16) and remaining scalar
expressions (X7, X8, X15), with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.functions import expr as E
from skyledger.operators import quality as Q
from skyledger.operators import runs as R
from skyledger.plans import fixtures as X
from skyledger.plans.run_queries import LOG, run_log
from skyledger.plans.unify_queries import search_catalog
from skyledger.plans.view_queries import CUST_CTE

KEY = ["domain", "subdomain", "record_type", "data", "source"]


def q1_snapshot_key_violations(s, sf):
    """Keys held twice when a batch is appended to the snapshot unmerged."""
    batch = X.dns_batch(s, sf).withColumn("source", F.lit(X.DNS_SOURCE))
    return Q.unique_key_violations(X.dns_snapshot(s, sf).select(*KEY).unionByName(batch.select(*KEY)), KEY)


QUERIES = {
    "q1_batch_key_violations": lambda s, sf: Q.unique_key_violations(X.domain_batch(s, sf), ["domain"]),
    "q1_snapshot_key_violations": q1_snapshot_key_violations,
    "q2_running_run_violations": lambda s, sf: Q.running_run_violations(R.current_runs(run_log(s, sf))),
    "q3_field_conformance": lambda s, sf: Q.field_conformance(search_catalog(s, sf)),
    "x7_x8_format_and_label": lambda s, sf: X.table(s, sf, "orders").select(
        "o_orderkey", E.format_date(F.to_date("o_orderdate")).alias("day"),
        E.service_label(F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")), "capitalize").alias("cap"),
        E.service_label(F.concat(F.lower("o_orderstatus"), F.lit("_x_y")), "upper_first_underscore").alias("up")),
    "x15_raw_json": lambda s, sf: X.table(s, sf, "customer").select(
        "c_custkey", E.raw_json("c_custkey", "c_name", "c_mktsegment").alias("raw")),
}

SQL = {
    "q1_batch_key_violations": """SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, CAST(count(*) AS BIGINT) AS rows
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderpriority = '1-URGENT'
GROUP BY 1 HAVING count(*) > 1""",
    "q1_snapshot_key_violations": """SELECT domain, subdomain, record_type, data, source, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
  l_returnflag AS record_type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag,
  CAST(l_partkey AS VARCHAR), l_linestatus FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1999-01-01' AND l_linestatus = 'F')
GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""",
    "q2_running_run_violations": "WITH " + LOG + """ SELECT collector_name,
  CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running FROM log GROUP BY 1
  HAVING count(*) FILTER (WHERE status = 'running') > 1""",
    "q3_field_conformance": f"""WITH {CUST_CTE}
SELECT 'aws' AS provider, 'customers' AS service, 'name' AS name_field, true AS field_present,
  CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE name <> '') AS BIGINT) AS named_rows FROM cust
UNION ALL SELECT 'aws', 'suppliers', 'supplier_name', false, CAST(count(*) AS BIGINT), CAST(0 AS BIGINT) FROM supplier
UNION ALL SELECT 'gcp', 'parts', 'p_name', true, CAST(count(*) AS BIGINT),
  CAST(count(*) FILTER (WHERE p_name <> '') AS BIGINT) FROM part
UNION ALL SELECT 'gcp', 'nations', 'n_name', true, CAST(count(*) AS BIGINT),
  CAST(count(*) FILTER (WHERE n_name <> '') AS BIGINT) FROM nation""",
    "x7_x8_format_and_label": r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  upper(substr(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), 1, 1))
    || substr(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), 2) AS cap,
  regexp_replace(upper(lower(o_orderstatus) || '_x_y'), '^([^_]*)_', '\1 ') AS up FROM orders""",
    "x15_raw_json": """SELECT c_custkey, CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name,
  c_mktsegment := c_mktsegment)) AS VARCHAR) AS raw FROM customer""",
}

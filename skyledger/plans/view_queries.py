"""Registered view queries (F1-F6, O1-O4, A1, A2, P1-P12) and SQL twins.

Input: ``customer`` joined to ``nation`` as an asset service: account = nation
name, status removed for every fifth key (absent for some), falsy cells
('' / 0 / false / empty list) spread by key, a map of tags and a nested
struct. The ordinal (input order) is the customer key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import render as R
from skyledger.functions.expr import cell_text, path
from skyledger.operators import gram_index as G
from skyledger.operators import ranking
from skyledger.operators import views as V
from skyledger.plans import fixtures as X
from skyledger.session import scratch_path

CUSTOMER_VIEW = V.ViewSpec.of("customers", "account name segment balance region code status")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = X.table(spark, sf, "customer")
    n = X.table(spark, sf, "nation")
    k = F.col("c_custkey")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        k.alias("_ordinal"),
        F.col("n_name").alias("account"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.when(k % 5 == 0, F.lit("removed")).when(k % 7 == 0, F.lit(None)).otherwise(F.lit("active"))
        .alias("status"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.lower("n_name")).alias("region"),
        F.when(k % 3 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("."), (k % 100).cast("string")))
        .when(k % 3 == 1, F.lower("c_mktsegment")).when(k % 2 == 0, F.lit("-")).otherwise(F.lit(""))
        .alias("code"),
        (F.col("c_acctbal") > 5000).alias("public"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.lit(None).cast("array<string>"))
        .otherwise(F.array("c_mktsegment", "n_name")).alias("groups"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("n_name")).alias("tags"),
        F.when(k % 6 == 0, F.lit(0)).otherwise(F.col("c_nationkey")).alias("node_count"),
        F.when(k % 4 == 0, F.lit("running")).when(k % 4 == 1, F.lit("stopped"))
        .when(k % 4 == 2, F.lit("pending")).alias("state"),
        F.struct(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
                 .alias("nation")).alias("meta"),
        F.when(k % 4 == 0, F.lit("aws")).when(k % 4 == 1, F.lit("Azure")).when(k % 4 == 2, F.lit("GCP"))
        .otherwise(F.lit("oracle")).alias("provider"))


def instances(spark: SparkSession, sf: str) -> DataFrame:
    """EC2-shaped instances from ``orders`` (no ``account`` field, as in the
    sample data; some public IPs missing)."""
    o = X.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("_ordinal"), F.concat(F.lit("i-"), k.cast("string")).alias("instance_id"),
        F.concat(F.lit("web-"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("instance_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit("running")).when(F.col("o_orderstatus") == "O", F.lit("stopped"))
        .otherwise(F.lit("pending")).alias("state"),
        F.concat(F.lit("10.0."), (k % 256).cast("string"), F.lit("."), (k % 7).cast("string")).alias("private_ip"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("54.1."), (k % 200).cast("string"), F.lit(".9"))).alias("public_ip"),
        F.concat(F.lit("region-"), (k % 5).cast("string")).alias("region"),
        F.when(F.col("o_orderstatus") == "P", F.lit("removed")).otherwise(F.lit("active")).alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("discovery_date"))


def p7_state_classes(spark, sf):
    """All four state-to-badge mappings over the instances' states."""
    df = instances(spark, sf)
    df = df.select("_ordinal", "state", F.upper("state").alias("power_state"),
                   F.when(F.col("state") == "running", F.lit("OK")).when(F.col("state") == "stopped", F.lit("ALARM"))
                   .otherwise(F.lit("INSUFFICIENT_DATA")).alias("state_value"))
    return df.select("_ordinal", R.state_class(df, "state", R.EC2_STATE_CLASS).alias("ec2"),
                     R.state_class(df, "state", R.AZURE_POWER_CLASS).alias("azure"),
                     R.state_class(df, "power_state", R.GCP_POWER_CLASS).alias("gcp"),
                     R.state_class(df, "state_value", R.ALARM_STATE_CLASS).alias("alarm"))


def v1_catalog_view_ec2(spark, sf):
    from skyledger.catalog import VIEWS
    return V.table_view(instances(spark, sf), VIEWS["aws/ec2"], sort_col=2, direction="desc", page_no=2,
                        rows=100)


def _proj(df):
    return V.project_view(df, CUSTOMER_VIEW, keep=["_ordinal"])


def _render(fn):
    def q(spark, sf):
        df = customers(spark, sf)
        return df.select("_ordinal", fn(df).alias("value"))
    return q


def _page(name, direction, page_no, rows):
    def q(spark, sf):
        df = V.not_removed(customers(spark, sf))
        order = V.smart_order(df, name, direction)
        return V.project_view(V.page(df, page_no, rows, order, position="pos"), CUSTOMER_VIEW,
                              keep=["_ordinal", "pos"])
    return q


def _rank_page(name, direction, page_no, rows):
    def q(spark, sf):
        df = V.not_removed(customers(spark, sf))
        index = scratch_path(spark, f"rank-{uuid.uuid4().hex[:12]}")
        ranked = V.project_view(df, CUSTOMER_VIEW, keep=["_ordinal"])
        ranking.build_rank_index(ranked, V.smart_order(ranked, name, direction), index)
        return ranking.page_by_rank(spark, index, page_no, rows, position="pos")
    return q


def f6_gram_index(spark, sf):
    """F6 through the n-gram index of the row texts, equal to the scan."""
    df = customers(spark, sf)
    index = scratch_path(spark, f"grams-{uuid.uuid4().hex[:12]}")
    rows = V.project_view(df.withColumn("_strings", F.array(V.row_text(df, CUSTOMER_VIEW))), CUSTOMER_VIEW, keep=["_ordinal", "_strings"])
    G.build_gram_index(rows, "_strings", index)
    return G.search_grams(spark, index, "_strings", " BUILDING 7").drop("_strings")


def o1_smart_sort_keys(spark, sf):
    df = customers(spark, sf)
    b, n, t = V.smart_sort_keys(df, "code")
    return df.select("_ordinal", b.alias("bucket"), n.alias("num"), t.alias("text"))


_LARGE = ["1e20", "1.2345678901234568e20", "9.3e18", "-9.5e18", "1e21", "1e-7", "2251799813685249.5", "o_orderkey"]
_LARGE_TEXT = ["100000000000000000000", "123456789012345680000", "9300000000000000000", "-9500000000000000000", "1e+21", "1e-7", "2251799813685249.5"]


def x14_large_numbers(spark, sf):
    """Numbers as the views print them, beyond what fits a long too."""
    k = F.col("o_orderkey")
    v = k.cast("double")
    for i, text in enumerate(_LARGE[:-1]):
        v = F.when(k % 8 == i, F.lit(float(text))).otherwise(v)
    df = X.table(spark, sf, "orders").select(k.alias("_ordinal"), v.alias("v"))
    return df.select("_ordinal", cell_text(df, "v").alias("value"))


QUERIES = {
    "x14_large_numbers": x14_large_numbers,
    "f1_not_removed": lambda s, sf: _proj(V.not_removed(customers(s, sf))),
    "f2_only_removed": lambda s, sf: _proj(V.only_removed(customers(s, sf))),
    "f3_get_domains": lambda s, sf: X.finalize(V.get_domains(X.domain_snapshot(s, sf), "removed", "3-MEDIUM")),
    "f3_get_dns_records": lambda s, sf: X.finalize(V.get_dns_records(X.dns_snapshot(s, sf), "active", "O")),
    "f4_filter_account": lambda s, sf: _proj(V.filter_account(customers(s, sf), "NATION_7")),
    "f5_filter_columns": lambda s, sf: _proj(V.filter_columns(customers(s, sf),
                                                              {"name": "00001", "segment": "MACH"})),
    "f6_search_rows": lambda s, sf: _proj(V.search_rows(customers(s, sf), "Furniture 5", CUSTOMER_VIEW)),
    "o1_smart_sort_keys": o1_smart_sort_keys,
    "o3_page_code_asc": _page("code", "asc", 1, 50),
    "o3_page_balance_desc": _page("balance", "desc", 0, 100),
    "o3_page_region_desc": _page("region", "desc", 2, 250),
    "o3_rank_page_desc": _rank_page("balance", "desc", 1, 50),
    "o3_rank_page_asc": _rank_page("code", "asc", 2, 25),
    "f6_gram_index": f6_gram_index,
    "o3_page_keyset": lambda s, sf: _proj(V.page_after(customers(s, sf), ["segment", "_ordinal"],
                                                       ("BUILDING", 500), 50)),
    "o4_page_summary": lambda s, sf: V.page_summary(V.not_removed(customers(s, sf)), 3, 50),
    "a1_status_stats": lambda s, sf: V.status_stats(customers(s, sf)),
    "a1_status_by_account": lambda s, sf: V.status_stats(customers(s, sf), ["account"]),
    "a2_accounts": lambda s, sf: V.accounts(V.not_removed(customers(s, sf))),
    "p1_project_view": lambda s, sf: V.project_view(
        customers(s, sf), V.ViewSpec.of("v", "account name absent_field meta.nation.name"), keep=["_ordinal"]),
    "p2_hide_columns": lambda s, sf: V.hide_columns(customers(s, sf), CUSTOMER_VIEW, [1, 3]),
    "p3_path": lambda s, sf: (lambda df: df.select(
        "_ordinal", path(df, "meta.nation.name").alias("nation_name"),
        path(df, "meta.nation.region").alias("nation_region"),
        path(df, "tags.segment").alias("tag_segment"),
        path(df, "meta.nation.missing").alias("missing")))(customers(s, sf)),
    "p4_or_default": _render(lambda df: R.or_default(df, "region", "-")),
    "p4_or_default_number": _render(lambda df: R.or_default(df, "node_count", "None")),
    "p5_bool_label": _render(lambda df: R.bool_label(df, "public", "Public", "Private")),
    "p6_list_label": _render(lambda df: R.list_label(df, "groups")),
    "p6_list_label_null_only": _render(lambda df: R.list_label(df, "groups", empty_as_dash=False)),
    "p7_state_class": _render(lambda df: R.state_class(df, "state", R.EC2_STATE_CLASS)),
    "p8_badge_type": _render(lambda df: R.badge_type(df, "segment")),
    "p9_with_unit": _render(lambda df: R.with_unit(df, "node_count", "ms", "Never")),
    "p10_tags_text": _render(lambda df: R.tags_text(df, "tags")),
    "p10_explode_tags": lambda s, sf: R.explode_tags(customers(s, sf)).select("_ordinal", "tag_key", "tag_value"),
    "e2_table_view": lambda s, sf: V.table_view(customers(s, sf), CUSTOMER_VIEW, account="NATION_3", search="a",
                                                column_filters={"segment": "o"}, sort_col=3, direction="desc",
                                                page_no=0, rows=50),
    "v1_catalog_view_ec2": v1_catalog_view_ec2,
    "p7_state_classes": p7_state_classes,
    "p11_provider_code": _render(lambda df: R.provider_code("provider")),
    "p12_row_class": _render(lambda df: R.row_class(df)),
}

# --- SQL twins ---------------------------------------------------------------
CUST_CTE = """cust AS (
 SELECT c_custkey AS _ordinal, n_name AS account, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance,
   CASE WHEN c_custkey % 5 = 0 THEN 'removed' WHEN c_custkey % 7 = 0 THEN NULL ELSE 'active' END AS status,
   CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(n_name) END AS region,
   CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS VARCHAR) || '.' || CAST(c_custkey % 100 AS VARCHAR)
        WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) WHEN c_custkey % 2 = 0 THEN '-' ELSE '' END AS code,
   c_acctbal > 5000 AS public,
   CASE WHEN c_custkey % 4 = 0 THEN []::VARCHAR[] WHEN c_custkey % 4 = 1 THEN NULL
        ELSE [c_mktsegment, n_name] END AS groups,
   CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE c_nationkey END AS node_count,
   CASE c_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'stopped' WHEN 2 THEN 'pending' END AS state,
   n_regionkey,
   CASE c_custkey % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'Azure' WHEN 2 THEN 'GCP' ELSE 'oracle' END AS provider
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

# JS String(balance) and cell text of each view field
BAL = ("CASE WHEN balance = floor(balance) THEN CAST(CAST(balance AS BIGINT) AS VARCHAR) "
       "ELSE CAST(balance AS VARCHAR) END")
CELL = {
    "account": "coalesce(account, '')", "name": "coalesce(name, '')", "segment": "coalesce(segment, '')",
    "balance": f"CASE WHEN balance <> 0 THEN {BAL} ELSE '' END",
    "region": "coalesce(region, '')", "code": "coalesce(code, '')", "status": "coalesce(status, '')",
}
PROJ = "_ordinal, account, name, segment, balance, region, code, status"
NUM_RE = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _keys_sql(text_expr: str) -> str:
    t = f"lower(coalesce({text_expr}, ''))"
    num = f"TRY_CAST(NULLIF(regexp_extract({t}, '{NUM_RE}', 1), '') AS DOUBLE)"
    return (f"CASE WHEN {num} IS NOT NULL THEN 1 WHEN {t} < '0' THEN 0 ELSE 2 END AS bucket, "
            f"{num} AS num, {t} AS text")


def _order_sql(direction: str) -> str:
    if direction == "desc":
        return ("bucket DESC NULLS LAST, (CASE WHEN bucket = 1 THEN num END) DESC NULLS LAST, "
                "(CASE WHEN bucket <> 1 THEN text END) DESC NULLS LAST, _ordinal ASC")
    return ("bucket ASC NULLS FIRST, (CASE WHEN bucket = 1 THEN num END) ASC NULLS FIRST, "
            "(CASE WHEN bucket <> 1 THEN text END) ASC NULLS FIRST, _ordinal ASC")


def _page_sql(col_text: str, direction: str, page_no: int, rows: int) -> str:
    return f"""WITH {CUST_CTE}, k AS (SELECT *, {_keys_sql(col_text)} FROM cust
  WHERE status IS DISTINCT FROM 'removed'),
p AS (SELECT *, row_number() OVER (ORDER BY {_order_sql(direction)}) AS pos FROM k)
SELECT {PROJ}, pos FROM p WHERE pos > {page_no * rows} AND pos <= {page_no * rows + rows}"""


def _render_sql(expr: str) -> str:
    return f"WITH {CUST_CTE} SELECT _ordinal, {expr} AS value FROM cust"


_ROW_TEXT = "lower(concat_ws(' ', " + ", ".join(CELL[f] for f in CUSTOMER_VIEW.fields) + "))"

SQL = {
    "x14_large_numbers": "SELECT o_orderkey AS _ordinal, CASE o_orderkey % 8 "
                         + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_LARGE_TEXT))
                         + " ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM orders",
    "f1_not_removed": f"WITH {CUST_CTE} SELECT {PROJ} FROM cust WHERE status IS DISTINCT FROM 'removed'",
    "f2_only_removed": f"WITH {CUST_CTE} SELECT {PROJ} FROM cust WHERE status = 'removed'",
    "f3_get_domains": """WITH s AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS registrar,
         CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(max(o_orderdate) AS DATE) + 365 AS expiry_date,
         CAST(min(o_orderdate) AS DATE) AS discovery_date, CAST(max(o_orderdate) AS DATE) AS last_seen
  FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2)
SELECT domain, registrar, status, strftime(expiry_date, '%Y-%m-%d') AS expiry_date,
       strftime(discovery_date, '%Y-%m-%d') AS discovery_date, strftime(last_seen, '%Y-%m-%d') AS last_seen
FROM s WHERE status = 'removed' AND registrar = '3-MEDIUM'""",
    "f3_get_dns_records": """WITH s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source,
         CASE WHEN max(l_shipdate) < TIMESTAMP '1997-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(min(l_shipdate) AS DATE) AS discovery_date, CAST(max(l_shipdate) AS DATE) AS last_seen
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5)
SELECT domain, subdomain, type, data, source, status, strftime(discovery_date, '%Y-%m-%d') AS discovery_date,
       strftime(last_seen, '%Y-%m-%d') AS last_seen FROM s WHERE status = 'active' AND source = 'O'""",
    "f4_filter_account": f"WITH {CUST_CTE} SELECT {PROJ} FROM cust WHERE account = 'NATION_7'",
    "f5_filter_columns": f"""WITH {CUST_CTE} SELECT {PROJ} FROM cust
  WHERE contains(lower({CELL['name']}), '00001') AND contains(lower({CELL['segment']}), 'mach')""",
    "f6_search_rows": f"WITH {CUST_CTE} SELECT {PROJ} FROM cust WHERE contains({_ROW_TEXT}, 'furniture 5')",
    "o1_smart_sort_keys": f"WITH {CUST_CTE} SELECT _ordinal, {_keys_sql('code')} FROM cust",
    "o3_page_code_asc": _page_sql("code", "asc", 1, 50),
    "o3_page_balance_desc": _page_sql(BAL, "desc", 0, 100),
    "o3_page_region_desc": _page_sql("region", "desc", 2, 250),
    "o3_rank_page_desc": _page_sql(BAL, "desc", 1, 50),
    "o3_rank_page_asc": _page_sql("code", "asc", 2, 25),
    "f6_gram_index": f"WITH {CUST_CTE} SELECT {PROJ} FROM cust WHERE contains({_ROW_TEXT}, 'building 7')",
    "o3_page_keyset": f"""WITH {CUST_CTE} SELECT {PROJ} FROM cust
  WHERE segment > 'BUILDING' OR (segment = 'BUILDING' AND _ordinal > 500)
  ORDER BY segment, _ordinal LIMIT 50""",
    "o4_page_summary": f"""WITH {CUST_CTE}, t AS (SELECT count(*) AS total FROM cust
  WHERE status IS DISTINCT FROM 'removed')
SELECT CAST(CASE WHEN total > 0 THEN 151 ELSE 0 END AS BIGINT) AS from_row,
       CAST(least(200, total) AS BIGINT) AS to_row, CAST(total AS BIGINT) AS total,
       CAST(greatest(ceil(total / 50), 1) AS BIGINT) AS pages FROM t""",
    "a1_status_stats": f"""WITH {CUST_CTE} SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS active,
  CAST(count(*) FILTER (WHERE status = 'removed') AS BIGINT) AS removed FROM cust""",
    "a1_status_by_account": f"""WITH {CUST_CTE} SELECT account, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS active,
  CAST(count(*) FILTER (WHERE status = 'removed') AS BIGINT) AS removed FROM cust GROUP BY account""",
    "a2_accounts": f"""WITH {CUST_CTE} SELECT DISTINCT account FROM cust
  WHERE status IS DISTINCT FROM 'removed' AND account <> '' AND account IS NOT NULL""",
    "p1_project_view": f"""WITH {CUST_CTE} SELECT _ordinal, account, name, CAST(NULL AS VARCHAR) AS absent_field,
  account AS meta_nation_name FROM cust""",
    "p2_hide_columns": f"WITH {CUST_CTE} SELECT account, segment, region, code, status FROM cust",
    "p3_path": f"""WITH {CUST_CTE} SELECT _ordinal, account AS nation_name, n_regionkey AS nation_region,
  segment AS tag_segment, CAST(NULL AS VARCHAR) AS missing FROM cust""",
    "p4_or_default": _render_sql("CASE WHEN region <> '' THEN region ELSE '-' END"),
    "p4_or_default_number": _render_sql(
        "CASE WHEN node_count <> 0 THEN CAST(node_count AS VARCHAR) ELSE 'None' END"),
    "p5_bool_label": _render_sql("CASE WHEN public THEN 'Public' ELSE 'Private' END"),
    "p6_list_label": _render_sql(
        "CASE WHEN groups IS NOT NULL AND len(groups) > 0 THEN array_to_string(groups, ', ') ELSE '-' END"),
    "p6_list_label_null_only": _render_sql(
        "CASE WHEN groups IS NOT NULL THEN array_to_string(groups, ', ') ELSE '-' END"),
    "p7_state_class": _render_sql(
        "CASE WHEN state = 'running' THEN 'running' WHEN state = 'stopped' THEN 'stopped' ELSE 'terminated' END"),
    "p8_badge_type": _render_sql("lower(segment)"),
    "p9_with_unit": _render_sql(
        "CASE WHEN node_count <> 0 THEN CAST(node_count AS VARCHAR) || 'ms' ELSE 'Never' END"),
    "p10_tags_text": _render_sql("'segment: ' || segment || ' nation: ' || account"),
    "p10_explode_tags": f"""WITH {CUST_CTE} SELECT _ordinal, 'segment' AS tag_key, segment AS tag_value FROM cust
UNION ALL SELECT _ordinal, 'nation', account FROM cust""",
    "e2_table_view": f"""WITH {CUST_CTE}, k AS (SELECT *, {_keys_sql(BAL)} FROM cust
  WHERE status IS DISTINCT FROM 'removed' AND account = 'NATION_3' AND contains({_ROW_TEXT}, 'a')
    AND contains(lower({CELL['segment']}), 'o')),
p AS (SELECT *, row_number() OVER (ORDER BY {_order_sql('desc')}) AS pos FROM k)
SELECT {PROJ} FROM p WHERE pos <= 50""",
    "p7_state_classes": """WITH i AS (SELECT o_orderkey AS _ordinal,
  CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'stopped' ELSE 'pending' END AS state FROM orders),
j AS (SELECT *, upper(state) AS power_state,
  CASE state WHEN 'running' THEN 'OK' WHEN 'stopped' THEN 'ALARM' ELSE 'INSUFFICIENT_DATA' END AS state_value FROM i)
SELECT _ordinal,
  CASE state WHEN 'running' THEN 'running' WHEN 'stopped' THEN 'stopped' ELSE 'terminated' END AS ec2,
  CASE state WHEN 'running' THEN 'running' WHEN 'stopped' THEN 'stopped' ELSE 'terminated' END AS azure,
  CASE power_state WHEN 'RUNNING' THEN 'running' WHEN 'TERMINATED' THEN 'stopped' ELSE 'terminated' END AS gcp,
  CASE state_value WHEN 'OK' THEN 'active' WHEN 'ALARM' THEN 'removed' ELSE 'stopped' END AS alarm FROM j""",
    "v1_catalog_view_ec2": f"""WITH inst AS (SELECT o_orderkey AS _ordinal, 'i-' || CAST(o_orderkey AS VARCHAR) AS instance_id,
  'web-' || CAST(o_custkey AS VARCHAR) AS name, o_orderpriority AS instance_type,
  CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'stopped' ELSE 'pending' END AS state,
  '10.0.' || CAST(o_orderkey % 256 AS VARCHAR) || '.' || CAST(o_orderkey % 7 AS VARCHAR) AS private_ip,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '54.1.' || CAST(o_orderkey % 200 AS VARCHAR) || '.9' END AS public_ip,
  'region-' || CAST(o_orderkey % 5 AS VARCHAR) AS region,
  CASE WHEN o_orderstatus = 'P' THEN 'removed' ELSE 'active' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS discovery_date FROM orders),
k AS (SELECT *, {_keys_sql('name')} FROM inst WHERE status IS DISTINCT FROM 'removed'),
p AS (SELECT *, row_number() OVER (ORDER BY {_order_sql('desc')}) AS pos FROM k)
SELECT _ordinal, CAST(NULL AS VARCHAR) AS account, instance_id, name, instance_type, state, private_ip,
  CASE WHEN public_ip <> '' THEN public_ip ELSE '-' END AS public_ip, region, status, discovery_date
FROM p WHERE pos > 200 AND pos <= 300""",
    "p11_provider_code": _render_sql(
        "CASE lower(provider) WHEN 'aws' THEN 'AWS' WHEN 'azure' THEN 'AZ' WHEN 'gcp' THEN 'GCP' "
        "WHEN 'godaddy' THEN 'GD' WHEN 'cloudflare' THEN 'CF' ELSE provider END"),
    "p12_row_class": _render_sql("CASE WHEN status = 'removed' THEN 'removed' ELSE '' END"),
}

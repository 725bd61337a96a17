"""Registered unify/search queries (U1-U3, F7-F9, A3, A6, G1, G2, W3) and
their SQL twins.

Removed-asset input: ``orders``, ``supplier`` and ``part`` as three services
of one provider with different name columns and removed dates (ISO text,
'N/A', null, unparseable). Search input: the customer service of the view
queries, ``supplier``, ``part`` and ``nation`` as services of two providers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skyledger.catalog import REMOVED_VIEWS
from skyledger.operators import gram_index as G
from skyledger.operators import unify as U
from skyledger.operators import views as V
from skyledger.plans import fixtures as X
from skyledger.plans.view_queries import CUST_CTE, customers
from skyledger.session import scratch_path


SERVICE_KEYS = {"cloudflare": ("sql-servers", "storage", "ad-users")}


def removed_catalog(spark: SparkSession, sf: str, provider: str = "azure") -> list[U.Service]:
    o = X.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    orders = o.select(
        k.alias("_ordinal"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("ord-"), k.cast("string"))).alias("name"),
        F.concat(F.lit("Order "), k.cast("string")).alias("display_name"),
        F.col("o_orderpriority").alias("resource_group"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderstatus")).alias("location"),
        F.when(F.col("o_orderstatus") == "F", F.lit("removed")).otherwise(F.lit("active")).alias("status"),
        F.when(k % 10 == 0, F.lit("N/A")).when(k % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("removed_date"))
    s = X.table(spark, sf, "supplier")
    sk = F.col("s_suppkey")
    suppliers = s.select(
        sk.alias("_ordinal"), F.col("s_name").alias("name"),
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("location"),
        F.when(F.col("s_acctbal") < 1000, F.lit("removed")).otherwise(F.lit("active")).alias("status"),
        F.when(sk % 2 == 0, F.lit("1998-06-15T10:00:00")).otherwise(F.lit("garbage")).alias("removed_date"),
        F.when(sk % 3 == 0, F.lit("acct-a")).otherwise(F.lit("")).alias("account"))
    p = X.table(spark, sf, "part")
    pk = F.col("p_partkey")
    parts = p.select(
        pk.alias("_ordinal"), F.col("p_name").alias("display_name"),
        F.when(F.col("p_size") < 10, F.lit("removed")).otherwise(F.lit("active")).alias("status"),
        F.col("p_brand").alias("region_id"),
        F.when(pk % 2 == 0, F.col("p_type")).otherwise(F.lit("")).alias("instance_name"))
    k1, k2, k3 = SERVICE_KEYS.get(provider, ("sql_servers", "storage", "ad_users"))
    return [U.Service(provider, k1, orders), U.Service(provider, k2, suppliers), U.Service(provider, k3, parts)]


def dns_catalog(spark, sf) -> list[U.Service]:
    return [U.Service("dns", "domains", X.domain_snapshot(spark, sf)),
            U.Service("dns", "subdomains", X.dns_snapshot(spark, sf).withColumnRenamed("record_type", "type"))]


def search_catalog(spark: SparkSession, sf: str) -> list[U.Service]:
    sup = X.table(spark, sf, "supplier").withColumn("_ordinal", F.col("s_suppkey"))
    part = X.table(spark, sf, "part").withColumn("_ordinal", F.col("p_partkey"))
    nat = X.table(spark, sf, "nation").withColumn("_ordinal", F.col("n_nationkey").cast("long"))
    return [U.Service("aws", "customers", customers(spark, sf), "name", "aws/customers.html"),
            U.Service("aws", "suppliers", sup, "supplier_name", "aws/suppliers.html"),
            U.Service("gcp", "parts", part, "p_name", "gcp/parts.html"),
            U.Service("gcp", "nations", nat, "n_name", "gcp/nations.html")]


def g1_search_index(spark, sf):
    """The search index written once (partitioned by provider), then searched."""
    path = scratch_path(spark, f"search-index-{uuid.uuid4().hex[:12]}")
    U.build_search_index(search_catalog(spark, sf)).write.partitionBy("provider").parquet(path)
    return U.search_index(spark.read.parquet(path), "red", ["aws", "gcp"])


def g1_gram_index(spark, sf):
    """The search index with an n-gram index over its texts, searched without reading all of them."""
    path = scratch_path(spark, f"gram-search-{uuid.uuid4().hex[:12]}")
    G.build_gram_index(U.build_search_index(search_catalog(spark, sf)), "_strings", path)
    return G.search_grams(spark, path, "_strings", "Red").drop("_strings")


def _removed_orders_view():
    return V.ViewSpec.of("sql", "name display_name resource_group location removed_date status")


def _listed(spark, sf, provider: str) -> list[U.Service]:
    """Every service of a provider's removed lists, its fields derived from ``supplier``."""
    sup, k = X.table(spark, sf, "supplier"), F.col("s_suppkey")
    out = []
    for i, (service, view) in enumerate(REMOVED_VIEWS[provider].items()):
        plain = [F.concat(F.lit(f + "-"), k.cast("string")).alias(f) for f in view.fields if f not in ("removed_date", "status")]
        out.append(U.Service(provider, service, sup.select(
            k.alias("_ordinal"), *plain, F.when(k % (i + 2) < 2, F.lit("removed")).otherwise(F.lit("active")).alias("status"),
            F.when(k % 3 == 0, F.lit("1998-06-15")).when(k % 3 == 1, F.lit("1999-01-01")).alias("removed_date"))))
    return out


def _u3(provider: str):
    def q(spark, sf):
        rows = U.removed_services(_listed(spark, sf, provider), REMOVED_VIEWS[provider], "1998-01-01", "1998-12-31")
        cell = lambda c: F.concat(c["title"], F.lit("="), F.coalesce(c["value"], F.lit("")))
        return rows.select("provider", "service", "_ordinal", F.array_join(F.transform("cells", cell), "; ").alias("cells"))
    return q


def _u3_sql(provider: str) -> str:
    parts = []
    for i, (service, view) in enumerate(REMOVED_VIEWS[provider].items()):
        date = "CASE s_suppkey % 3 WHEN 0 THEN '1998-06-15' WHEN 1 THEN '1999-01-01' END"
        value = {"removed_date": f"coalesce({date}, '')", "status": "'removed'"}
        cells = " || '; ' || ".join(f"'{c.title}=' || " + value.get(c.data, f"'{c.data}-' || CAST(s_suppkey AS VARCHAR)") for c in view.columns)
        parts.append(f"SELECT '{provider}' AS provider, '{service}' AS service, s_suppkey AS _ordinal, {cells} AS cells FROM supplier "
                     f"WHERE s_suppkey % {i + 2} < 2 AND s_suppkey % 3 <> 1")
    return " UNION ALL ".join(parts)


QUERIES = {
    "u1_removed_assets": lambda s, sf: X.finalize(
        U.removed_assets(X.domain_snapshot(s, sf), X.dns_snapshot(s, sf)).drop(*U.REMOVED_ORDER)),
    "u2_removed_azure": lambda s, sf: U.removed_unified(removed_catalog(s, sf), "azure",
                                                        "1995-06-01", "1998-12-31"),
    "u2_removed_alibaba": lambda s, sf: U.removed_unified(removed_catalog(s, sf, "alibaba"), "alibaba"),
    "u2_removed_dns": lambda s, sf: U.removed_unified(dns_catalog(s, sf), "dns", "1996-06-01", "1997-06-30"),
    **{f"u2_removed_{p}": (lambda p: lambda s, sf: U.removed_unified(removed_catalog(s, sf, p), p))(p)
       for p in ("gcp", "cloudflare", "digitalocean", "oracle", "aws")},
    "u2_removed_dns_literal": lambda s, sf: U.removed_unified(dns_catalog(s, sf), "dns",
                                                              last_seen_fallback=False),
    "a1_status_dashboard": lambda s, sf: U.status_dashboard(removed_catalog(s, sf)),
    "u3_removed_service": lambda s, sf: U.removed_service(removed_catalog(s, sf)[0].df, _removed_orders_view(),
                                                          "1996-01-01", "1997-12-31", keep=["_ordinal"]),
    "f7_filter_removed_between": lambda s, sf: V.filter_removed_between(
        removed_catalog(s, sf)[1].df, "1998-06-01", "1998-06-15"),
    "a6_removed_total": lambda s, sf: V.removed_total(
        U.removed_unified(removed_catalog(s, sf), "azure", "1995-06-01", "1998-12-31")),
    "g1_global_search": lambda s, sf: U.global_search(search_catalog(s, sf), "red"),
    "g1_global_search_aws": lambda s, sf: U.global_search(search_catalog(s, sf), " 00000 ", ["aws"]),
    "f8_filter_providers": lambda s, sf: U.global_search(search_catalog(s, sf), "on", ["gcp"]),
    "g1_search_index": g1_search_index,
    "g1_gram_index": g1_gram_index,
    "f9_match_any_string": lambda s, sf: V.match_any_string(customers(s, sf), ".3").select(
        "_ordinal", "code"),
    "a3_search_counts": lambda s, sf: U.search_counts(U.global_search(search_catalog(s, sf), "red")),
    "a3_search_totals": lambda s, sf: U.search_totals(U.global_search(search_catalog(s, sf), "00")),
    "a3_search_rollup": lambda s, sf: U.search_rollup(U.global_search(search_catalog(s, sf), "on")),
    "w3_top_hits": lambda s, sf: U.top_hits(U.global_search(search_catalog(s, sf), "00"), 10),
    "g2_mark_matches": lambda s, sf: U.global_search(search_catalog(s, sf), "red").select(
        "service", "_ordinal", U.mark_matches("name", "Red").alias("marked")),
}

# --- SQL twins ---------------------------------------------------------------
_REM = """o AS (SELECT o_orderkey AS _ordinal,
   CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'ord-' || CAST(o_orderkey AS VARCHAR) END AS name,
   'Order ' || CAST(o_orderkey AS VARCHAR) AS display_name, o_orderpriority AS resource_group,
   CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS location,
   CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status,
   CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' WHEN o_orderkey % 10 = 1 THEN NULL
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS removed_date FROM orders),
su AS (SELECT s_suppkey AS _ordinal, s_name AS name, 'nation-' || CAST(s_nationkey AS VARCHAR) AS location,
   CASE WHEN s_acctbal < 1000 THEN 'removed' ELSE 'active' END AS status,
   CASE WHEN s_suppkey % 2 = 0 THEN '1998-06-15T10:00:00' ELSE 'garbage' END AS removed_date,
   CASE WHEN s_suppkey % 3 = 0 THEN 'acct-a' ELSE '' END AS account FROM supplier),
pa AS (SELECT p_partkey AS _ordinal, p_name AS display_name,
   CASE WHEN p_size < 10 THEN 'removed' ELSE 'active' END AS status, p_brand AS region_id,
   CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS instance_name FROM part)"""


def _t(x: str) -> str:
    """Truthy text test of a string column."""
    return f"({x} IS NOT NULL AND {x} <> '')"


def _chain(items: list[str], default: str) -> str:
    if not items:
        return f"'{default}'"
    return "CASE " + " ".join(f"WHEN {_t(i)} THEN {i}" for i in items) + f" ELSE '{default}' END"


def _range(col: str, lo: str | None, hi: str | None) -> str:
    ts = f"TRY_CAST({col} AS TIMESTAMP)"
    cond = []
    if lo:
        cond.append(f"{ts} >= TIMESTAMP '{lo}'")
    if hi:
        cond.append(f"{ts} <= TIMESTAMP '{hi}'")
    return f"({ts} IS NULL OR ({' AND '.join(cond)}))"


_AZURE = f"""WITH {_REM}, u AS (
SELECT 'SQL SERVERS' AS service_type, {_chain(['name', 'display_name'], 'N/A')} AS name,
  'N/A' AS account, {_chain(['resource_group'], 'N/A')} AS resource_group, {_chain(['location'], 'N/A')} AS location,
  {_chain(['removed_date'], 'N/A')} AS removed_date, status FROM o WHERE status = 'removed'
UNION ALL
SELECT 'STORAGE', {_chain(['name'], 'N/A')}, {_chain(['account'], 'N/A')}, 'N/A', {_chain(['location'], 'N/A')},
  {_chain(['removed_date'], 'N/A')}, status FROM su WHERE status = 'removed'
UNION ALL
SELECT 'AD USERS', {_chain(['display_name'], 'N/A')}, 'N/A', 'N/A', 'N/A', 'N/A', status
FROM pa WHERE status = 'removed')"""

_SEARCH = f"""WITH {CUST_CTE}, hits AS (
SELECT 'aws' AS provider, 'customers' AS service, 'aws/customers.html' AS page,
  {_chain(['name'], 'Unknown')} AS name, {_chain(['account'], '-')} AS account, {_chain(['region'], '')} AS region,
  CASE WHEN status = 'active' THEN 'active' ELSE 'removed' END AS status_class,
  {_chain(['status'], 'unknown')} AS status_text, _ordinal
FROM cust WHERE coalesce(contains(lower(account), $q), false) OR coalesce(contains(lower(name), $q), false)
  OR coalesce(contains(lower(segment), $q), false) OR coalesce(contains(lower(status), $q), false)
  OR coalesce(contains(lower(region), $q), false) OR coalesce(contains(lower(code), $q), false)
  OR coalesce(contains(lower(state), $q), false) OR coalesce(contains(lower(provider), $q), false)
UNION ALL
SELECT 'aws', 'suppliers', 'aws/suppliers.html', 'Unknown', '-', '', 'removed', 'unknown', s_suppkey
FROM supplier WHERE contains(lower(s_name), $q)
UNION ALL
SELECT 'gcp', 'parts', 'gcp/parts.html', {_chain(['p_name'], 'Unknown')}, '-', '', 'removed', 'unknown', p_partkey
FROM part WHERE contains(lower(p_name), $q) OR contains(lower(p_brand), $q) OR contains(lower(p_type), $q)
UNION ALL
SELECT 'gcp', 'nations', 'gcp/nations.html', {_chain(['n_name'], 'Unknown')}, '-', '', 'removed', 'unknown',
  CAST(n_nationkey AS BIGINT) FROM nation WHERE contains(lower(n_name), $q))"""


def _search(q: str) -> str:
    return _SEARCH.replace("$q", f"'{q}'")


_HIT_COLS = "provider, service, page, name, account, region, status_class, status_text, _ordinal"

SQL = {
    "u1_removed_assets": """WITH s AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS registrar,
         CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(min(o_orderdate) AS DATE) AS discovery_date, CAST(max(o_orderdate) AS DATE) AS last_seen
  FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2),
r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS record_type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source,
         CASE WHEN max(l_shipdate) < TIMESTAMP '1997-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(min(l_shipdate) AS DATE) AS discovery_date, CAST(max(l_shipdate) AS DATE) AS last_seen
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5)
SELECT 'domain' AS asset_type, domain AS name, registrar AS provider, 'Domain removed from registrar' AS details,
       strftime(discovery_date, '%Y-%m-%d') AS discovery_date, strftime(last_seen, '%Y-%m-%d') AS removed_date,
       'removed' AS status FROM s WHERE status = 'removed'
UNION ALL
SELECT 'subdomain', CASE WHEN subdomain = '' THEN domain ELSE subdomain || '.' || domain END, source,
       record_type || ' record - ' || data, strftime(discovery_date, '%Y-%m-%d'), strftime(last_seen, '%Y-%m-%d'),
       'removed' FROM r WHERE status = 'removed'""",
    "u2_removed_azure": _AZURE + f" SELECT * FROM u WHERE {_range('removed_date', '1995-06-01', '1998-12-31')}",
    "u2_removed_alibaba": f"""WITH {_REM}
SELECT 'SQL_SERVERS' AS service_type, {_chain(['name'], 'N/A')} AS name, 'N/A' AS account,
  {_chain(['location'], 'N/A')} AS region, {_chain(['removed_date'], 'N/A')} AS removed_date, status
FROM o WHERE status = 'removed'
UNION ALL
SELECT 'STORAGE', {_chain(['name'], 'N/A')}, {_chain(['account'], 'N/A')}, {_chain(['location'], 'N/A')},
  {_chain(['removed_date'], 'N/A')}, status FROM su WHERE status = 'removed'
UNION ALL
SELECT 'AD_USERS', {_chain(['instance_name'], 'N/A')}, 'N/A', {_chain(['region_id'], 'N/A')}, 'N/A', status
FROM pa WHERE status = 'removed'""",
    "u2_removed_dns": """WITH s AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS registrar,
         CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'removed' ELSE 'active' END AS status,
         strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen
  FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2),
r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source,
         CASE WHEN max(l_shipdate) < TIMESTAMP '1997-01-01' THEN 'removed' ELSE 'active' END AS status,
         strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5),
u AS (
SELECT 'Domains' AS asset_type, domain AS name, registrar AS type, registrar AS source, last_seen AS removed_date, status
FROM s WHERE status = 'removed'
UNION ALL
SELECT 'Subdomains', domain, type, source, last_seen, status FROM r WHERE status = 'removed')
SELECT * FROM u WHERE """ + _range("removed_date", "1996-06-01", "1997-06-30"),
    "u2_removed_dns_literal": """WITH s AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS registrar,
         CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'removed' ELSE 'active' END AS status
  FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2),
r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source,
         CASE WHEN max(l_shipdate) < TIMESTAMP '1997-01-01' THEN 'removed' ELSE 'active' END AS status
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5)
SELECT 'Domains' AS asset_type, domain AS name, registrar AS type, registrar AS source, 'N/A' AS removed_date, status
FROM s WHERE status = 'removed'
UNION ALL
SELECT 'Subdomains', domain, type, source, 'N/A', status FROM r WHERE status = 'removed'""",
    "u3_removed_service": f"""WITH {_REM}
SELECT _ordinal, name, display_name, resource_group, location, removed_date, status FROM o
WHERE status = 'removed' AND {_range('removed_date', '1996-01-01', '1997-12-31')}""",
    "a1_status_dashboard": f"""WITH {_REM}
SELECT 'azure' AS provider, 'sql_servers' AS service, CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS active,
  CAST(count(*) FILTER (WHERE status = 'removed') AS BIGINT) AS removed FROM o
UNION ALL SELECT 'azure', 'storage', count(*), count(*) FILTER (WHERE status = 'active'),
  count(*) FILTER (WHERE status = 'removed') FROM su
UNION ALL SELECT 'azure', 'ad_users', count(*), count(*) FILTER (WHERE status = 'active'),
  count(*) FILTER (WHERE status = 'removed') FROM pa""",
    "f7_filter_removed_between": f"""WITH {_REM}
SELECT * FROM su WHERE {_range('removed_date', '1998-06-01', '1998-06-15')}""",
    "a6_removed_total": _AZURE + f""" SELECT CAST(count(*) AS BIGINT) AS total FROM u
WHERE {_range('removed_date', '1995-06-01', '1998-12-31')}""",
    "g1_global_search": _search("red") + f" SELECT {_HIT_COLS} FROM hits",
    "g1_global_search_aws": _search("00000") + f" SELECT {_HIT_COLS} FROM hits WHERE provider = 'aws'",
    "g1_gram_index": _search("red") + f" SELECT {_HIT_COLS} FROM hits",
    "g1_search_index": _search("red") + f" SELECT {_HIT_COLS} FROM hits",
    "f8_filter_providers": _search("on") + f" SELECT {_HIT_COLS} FROM hits WHERE provider = 'gcp'",
    "f9_match_any_string": f"""WITH {CUST_CTE} SELECT _ordinal, code FROM cust
WHERE contains(lower(account), '.3') OR contains(lower(name), '.3') OR contains(lower(segment), '.3')
  OR coalesce(contains(lower(status), '.3'), false) OR contains(lower(region), '.3')
  OR contains(lower(code), '.3') OR coalesce(contains(lower(state), '.3'), false)
  OR contains(lower(provider), '.3')""",
    "a3_search_counts": _search("red") + """ SELECT provider, service, CAST(count(*) AS BIGINT) AS hits
FROM hits GROUP BY 1, 2""",
    "a3_search_totals": _search("00") + """ SELECT CAST(count(*) AS BIGINT) AS total_hits,
  CAST(count(DISTINCT provider) AS BIGINT) AS providers_hit,
  CAST(count(DISTINCT (provider, service)) AS BIGINT) AS services_hit FROM hits""",
    "a3_search_rollup": _search("on") + """ SELECT provider, service, CAST(count(*) AS BIGINT) AS hits,
  CASE grouping(provider, service) WHEN 0 THEN 'service' WHEN 1 THEN 'provider' ELSE 'total' END AS level
FROM hits GROUP BY ROLLUP (provider, service)""",
    "w3_top_hits": _search("00") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY provider, service
  ORDER BY _ordinal) AS rank, count(*) OVER (PARTITION BY provider, service) AS hits FROM hits)
SELECT {_HIT_COLS}, CAST(rank AS INTEGER) AS rank, CAST(hits AS BIGINT) AS hits FROM r WHERE rank <= 10""",
    "g2_mark_matches": _search("red") + """ SELECT service, _ordinal,
  regexp_replace(name, '(?i)(red)', '<mark>\\1</mark>', 'g') AS marked FROM hits""",
}


# removed-asset projections of the other providers over the same three services
_FIELDS = {"o": ["name", "display_name", "resource_group", "location", "status", "removed_date"],
           "su": ["name", "location", "status", "removed_date", "account"],
           "pa": ["display_name", "status", "region_id", "instance_name"]}


def _label(key: str, rule: str) -> str:
    if rule == "capitalize":
        return key[:1].upper() + key[1:]
    up = key.upper()
    if rule == "upper_first_underscore":
        return up.replace("_", " ", 1)
    if rule == "upper_first_dash":
        return up.replace("-", " ", 1)
    return up


def _removed_sql(provider: str) -> str:
    rule, label_col, name_chain, extras = U.REMOVED_PROJECTIONS[provider]
    keys = dict(zip(("o", "su", "pa"), SERVICE_KEYS.get(provider, ("sql_servers", "storage", "ad_users"))))
    parts = []
    for alias, key in keys.items():
        have = _FIELDS[alias]
        cols = [f"'{_label(key, rule)}' AS {label_col}",
                _chain([f for f in name_chain if f in have], "N/A") + " AS name"]
        cols += [_chain([f for f in chain if f in have], "N/A") + f" AS {out}" for out, chain in extras]
        cols.append(_chain([f for f in ("removed_date", "last_seen") if f in have], "N/A") + " AS removed_date")
        cols.append("status")
        parts.append(f"SELECT {', '.join(cols)} FROM {alias} WHERE status = 'removed'")
    return f"WITH {_REM} " + " UNION ALL ".join(parts)


for _p in ("gcp", "cloudflare", "digitalocean", "oracle", "aws"):
    SQL[f"u2_removed_{_p}"] = _removed_sql(_p)

for _p in REMOVED_VIEWS:
    QUERIES[f"u3_removed_{_p}"] = _u3(_p)
    SQL[f"u3_removed_{_p}"] = _u3_sql(_p)

"""Registered source/sink queries (S1-S5, K1-K7): each writes derived data
to a fresh folder under the session's checkpoint folder and reads it back
through the engine's readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import merge as M
from skyledger.operators import normalize as N
from skyledger.operators import runs as R
from skyledger.operators import unify as U
from skyledger.operators import views as V
from skyledger import collection as C
from skyledger.plans import fixtures as X
from skyledger.plans import normalize_queries as NQ
from skyledger.plans.normalize_queries import AS_OF as N_AS_OF, godaddy_domain_docs
from skyledger.plans.run_queries import META, metadata_docs
from skyledger.plans.stream_queries import CHANGED, NEXT_DAY, REMOVED_DOMAINS, REMOVED_RECORDS
from skyledger.plans.view_queries import BAL, CUST_CTE, customers
from skyledger.schemas import DNS_DDL, DOMAINS_DDL
from skyledger.session import scratch_path
from skyledger.sources import envelope as E
from skyledger.sources import readers as S
from skyledger.sources import sinks as K

EXPORT_NOW = "2024-02-01T06:00:00Z"


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


ASSET_SCHEMA = "name STRING, account STRING, segment STRING, balance DOUBLE, status STRING, groups ARRAY<STRING>"


def _asset_docs(spark, sf) -> DataFrame:
    """Customer asset files: JSON arrays of <= 100 objects each."""
    c = customers(spark, sf)
    item = F.struct(F.col("_ordinal").alias("o"),
                    F.struct("name", "account", "segment", "balance", "status", "groups").alias("e"))
    return (c.groupBy((F.col("_ordinal") / 100).cast("long").alias("_doc"))
            .agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"])).alias("value")))


def _write_docs(docs: DataFrame, path: str) -> None:
    """One file per document (``_doc`` partitions hold one row each)."""
    docs.write.partitionBy("_doc").text(path)


def s1_read_assets(spark, sf):
    path = _scratch(spark, "assets")
    _write_docs(_asset_docs(spark, sf), path)
    df = S.read_assets(spark, f"{path}/*/*.txt", ASSET_SCHEMA)
    return df.select("name", "account", "segment", "balance", "status",
                     F.array_join("groups", ",").alias("groups"), "_ordinal")


def _catalog_files(spark, sf) -> list[S.CatalogEntry]:
    """Asset files of two layouts and schemas, a file cut short, a line cut short and a missing file."""
    path = _scratch(spark, "catalog")
    c = customers(spark, sf)
    item = F.struct(F.col("_ordinal").alias("o"), F.struct("name", "account", "status", "groups", "node_count").alias("e"))
    docs = (c.groupBy((F.col("_ordinal") / 100).cast("long").alias("_doc"))
            .agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"])).alias("value")))
    _write_docs(docs, f"{path}/customers")
    sup = X.table(spark, sf, "supplier").select(F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("value"))
    cut = F.lit('{"s_suppkey": 0, "s_name"').alias("value")
    sup.unionByName(spark.range(1).select(cut)).write.text(f"{path}/suppliers")
    spark.range(1).select(F.lit('[{"name": "cut sh').alias("value")).write.text(f"{path}/broken")
    return [S.CatalogEntry("aws", "customers", f"{path}/customers/*/*.txt", "Customers", "c.html", "name"),
            S.CatalogEntry("gcp", "suppliers", f"{path}/suppliers", "Suppliers", "s.html", "s_name"),
            S.CatalogEntry("gcp", "broken", f"{path}/broken", "Broken", "b.html", "name"),
            S.CatalogEntry("aws", "missing", f"{path}/missing.json", "Missing", "m.html", "name")]


def s2_read_catalog(spark, sf):
    """Every row of the catalog, and what could not be read."""
    e = E.read_envelope(spark, _catalog_files(spark, sf))
    none = F.lit(None).cast("string")
    rows = e.rows.select("provider", "service", "page", "name_field", F.to_json("row").alias("row"), none.alias("reason"))
    bad = e.errors.select("provider", "service", none.alias("page"), none.alias("name_field"), F.col("text").alias("row"), "reason")
    return rows.unionByName(bad)


def f9_envelope(spark, sf):
    """F9 and G1 over rows of two schemas in one scan."""
    return E.search_envelope(E.read_envelope(spark, _catalog_files(spark, sf)).rows, "00000").drop("_ordinal")


def s1_read_lines(spark, sf):
    """An exported JSON-lines table read back, the lines that are cut short beside it."""
    path = _scratch(spark, "lines")
    item = F.to_json(F.struct("name", "account", "segment", "balance", "status", "groups"))
    half = F.when(F.col("_ordinal") % 10 == 3, F.substring(item, 1, 9)).otherwise(item)
    customers(spark, sf).select(half.alias("value")).write.text(path)
    rows, errors = E.read_lines(spark, path, ASSET_SCHEMA)
    good = rows.select("name", "account", "segment", "balance", "status", F.array_join("groups", ",").alias("groups"))
    bad = errors.select(F.col("text").alias("name"), *[F.lit(None).cast(t).alias(c) for c, t in
                        (("account", "string"), ("segment", "string"), ("balance", "double"), ("status", "string"), ("groups", "string"))])
    return good.unionByName(bad)


def s1_read_export(spark, sf):
    """The engine's own export through ``read_assets`` (JSON lines told from arrays by their first character)."""
    path = _scratch(spark, "export")
    K.export_domains(X.domain_snapshot(spark, sf), path)
    return S.read_assets(spark, path, "domain STRING, status STRING, registrar STRING, last_seen STRING").drop("_source", "_ordinal")


def s3_read_snapshot(spark, sf):
    base = _scratch(spark, "snap")
    S.commit_snapshot(X.domain_snapshot(spark, sf), base)
    cur = S.read_snapshot(spark, base)
    merged = M.merge_domains(cur, X.domain_batch(spark, sf), X.DOM_SOURCE, X.DOM_AS_OF, X.DOM_NOW).snapshot
    S.commit_snapshot(merged, base, partition_by="registrar")
    return X.finalize(S.read_snapshot(spark, base))


def s5_read_landed(spark, sf):
    path = _scratch(spark, "landed")
    # pages land in fetch order: part files and lines follow the page number
    godaddy_domain_docs(spark, sf).orderBy("_doc").select("value").write.text(path)
    return X.finalize(N.normalize_godaddy_domains(S.read_landed(spark, path, lines=True), N_AS_OF)
                      .drop("_ordinal"))


def _read_json(spark, path, ddl):
    return spark.read.schema(ddl).json(path)


def k1_export_domains(spark, sf):
    path = _scratch(spark, "k1")
    K.export_domains(X.domain_snapshot(spark, sf), path)
    return _read_json(spark, path, "domain STRING, registrar STRING, status STRING, expiry_date STRING, "
                                   "discovery_date STRING, last_seen STRING")


def k2_export_dns(spark, sf):
    path = _scratch(spark, "k2")
    K.export_dns(X.dns_snapshot(spark, sf), path)
    return _read_json(spark, path, "domain STRING, subdomain STRING, type STRING, data STRING, source STRING, "
                                   "status STRING, discovery_date STRING, last_seen STRING")


def k3_export_removed(spark, sf):
    path = _scratch(spark, "k3")
    K.export_removed(U.removed_assets(X.domain_snapshot(spark, sf), X.dns_snapshot(spark, sf)), path)
    return _read_json(spark, path, "asset_type STRING, name STRING, provider STRING, details STRING, "
                                   "discovery_date STRING, removed_date STRING, status STRING")


def k4_update_metadata(spark, sf):
    path = _scratch(spark, "k4")
    meta = R.parse_metadata(metadata_docs(spark, sf))
    flat = K.update_metadata(meta, X.domain_snapshot(spark, sf), X.dns_snapshot(spark, sf), EXPORT_NOW)
    K.export_metadata(flat, path, EXPORT_NOW)
    return R.read_metadata(spark, path, lines=True)


CSV_VIEW = V.ViewSpec.of("customers-csv", "account name note balance public groups status")


def csv_input(spark, sf):
    c = customers(spark, sf)
    k = F.col("_ordinal")
    note = (F.when(k % 11 == 0, F.concat(F.lit('say "'), F.col("name"), F.lit('"')))
            .when(k % 7 == 0, F.concat(F.col("segment"), F.lit(", "), F.col("account")))
            .otherwise(F.col("segment")))
    return c.withColumn("note", note)


def k5_export_csv(spark, sf):
    path = _scratch(spark, "k5")
    df = V.not_removed(csv_input(spark, sf))
    K.export_csv(V.smart_sort(df, "name"), CSV_VIEW, path)
    return spark.read.text(path)


def k6_commit_snapshot(spark, sf):
    base = _scratch(spark, "k6")
    v0 = S.commit_snapshot(X.dns_snapshot(spark, sf), base, partition_by="source")
    v1 = S.commit_snapshot(M.merge_dns_records(S.read_snapshot(spark, base), X.dns_batch(spark, sf),
                                               X.DNS_SOURCE, X.DNS_AS_OF, X.DNS_NOW).snapshot,
                           base, partition_by="source")
    return X.finalize(S.read_snapshot(spark, base)).withColumn("versions_apart", F.lit(v1 - v0))


def k6_commit_source_partition(spark, sf):
    """Per-source store: merging registrar 1-URGENT rewrites only its partition."""
    from skyledger.schemas import DOMAINS_DDL
    store = S.SnapshotStore(spark, _scratch(spark, "k6s"), "registrar", DOMAINS_DDL)
    snap = X.domain_snapshot(spark, sf)
    for r in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]:
        store.commit(snap.filter(F.col("registrar") == r), r)
    m = M.merge_domains(store.read(), X.domain_batch(spark, sf), X.DOM_SOURCE, X.DOM_AS_OF, X.DOM_NOW)
    store.commit(m.source_rows, X.DOM_SOURCE)
    return X.finalize(store.read())


def k7_export_all(spark, sf):
    out = _scratch(spark, "k7")
    meta = R.parse_metadata(metadata_docs(spark, sf))
    # the exports read committed snapshots, as after a sync: neither is derived more than once
    S.commit_snapshot(X.domain_snapshot(spark, sf).select(*K.DOMAIN_EXPORT), f"{out}-domains")
    S.commit_snapshot(X.dns_snapshot(spark, sf).withColumnRenamed("record_type", "type").select(*K.DNS_EXPORT)
                      .withColumnRenamed("type", "record_type"), f"{out}-dns", sort_within=["domain", "subdomain"])
    K.export_all(S.read_snapshot(spark, f"{out}-domains"), S.read_snapshot(spark, f"{out}-dns"), meta, out, EXPORT_NOW)
    text = "{0} STRING, {1} STRING, {2} STRING"
    parts = [("domains", ["domain", "registrar", "status"]), ("subdomains", ["domain", "source", "status"]),
             ("removed", ["name", "provider", "removed_date"]), ("metadata", ["service", "provider_key", "last_updated"])]
    res = None
    for name, cols in parts:
        df = (R.read_metadata(spark, f"{out}/{name}", lines=True) if name == "metadata" else
              _read_json(spark, f"{out}/{name}", text.format(*cols)))
        r = df.select(F.lit(name).alias("file"), F.col(cols[0]).alias("name"), F.col(cols[1]).alias("provider"),
                      F.col(cols[2]).alias("value"))
        res = r if res is None else res.unionByName(r)
    return res


QUERIES = {
    "s1_read_assets": s1_read_assets,
    "s1_read_lines": s1_read_lines,
    "s1_read_export": s1_read_export,
    "s2_read_catalog": s2_read_catalog,
    "f9_envelope": f9_envelope,
    "s3_read_snapshot": s3_read_snapshot,
    "s5_read_landed": s5_read_landed,
    "k1_export_domains": k1_export_domains,
    "k2_export_dns": k2_export_dns,
    "k3_export_removed": k3_export_removed,
    "k4_update_metadata": k4_update_metadata,
    "k5_export_csv": k5_export_csv,
    "k6_commit_snapshot": k6_commit_snapshot,
    "k6_commit_source_partition": k6_commit_source_partition,
    "k7_export_all": k7_export_all,
}

# --- SQL twins ---------------------------------------------------------------
from skyledger.plans import merge_queries as MQ  # noqa: E402
from skyledger.plans import unify_queries as UQ  # noqa: E402

_DOM_S = """s AS (
  SELECT 'd' || CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS registrar,
         CASE WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(max(o_orderdate) AS DATE) + 365 AS expiry_date,
         CAST(min(o_orderdate) AS DATE) AS discovery_date, CAST(max(o_orderdate) AS DATE) AS last_seen
  FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderpriority = '1-URGENT') GROUP BY 1, 2)"""
_DNS_S = """r AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS domain, CAST(l_linenumber AS VARCHAR) AS subdomain,
         l_returnflag AS type, CAST(l_partkey AS VARCHAR) AS data, l_linestatus AS source,
         CASE WHEN max(l_shipdate) < TIMESTAMP '1997-01-01' THEN 'removed' ELSE 'active' END AS status,
         CAST(min(l_shipdate) AS DATE) AS discovery_date, CAST(max(l_shipdate) AS DATE) AS last_seen
  FROM lineitem WHERE NOT (l_shipdate >= TIMESTAMP '2000-01-01' AND l_linestatus = 'F') GROUP BY 1, 2, 3, 4, 5)"""


def _csv_cell(x: str) -> str:
    return (f"CASE WHEN contains({x}, ',') OR contains({x}, '\"') OR contains({x}, chr(10)) "
            f"THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END")


_CSV_COLS = [
    "account", "name",
    "CASE WHEN _ordinal % 11 = 0 THEN 'say \"' || name || '\"' WHEN _ordinal % 7 = 0 THEN segment || ', ' || account "
    "ELSE segment END",
    BAL, "CASE WHEN public THEN 'true' ELSE 'false' END",
    "coalesce(array_to_string(groups, ','), '')", "coalesce(status, '')",
]

SQL = {
    "s1_read_assets": f"""WITH {CUST_CTE} SELECT name, account, segment, balance, status,
  array_to_string(groups, ',') AS groups, _ordinal % 100 AS _ordinal FROM cust""",
    "s1_read_lines": f"""WITH {CUST_CTE} SELECT name, account, segment, balance, status,
  array_to_string(groups, ',') AS groups FROM cust WHERE _ordinal % 10 <> 3
UNION ALL SELECT '{{"name":"', NULL, NULL, NULL, NULL, NULL FROM cust WHERE _ordinal % 10 = 3""",
    "s1_read_export": f"""WITH {_DOM_S} SELECT domain, status, registrar, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM s""",
    "s2_read_catalog": f"""WITH {CUST_CTE}
SELECT 'aws' AS provider, 'customers' AS service, 'c.html' AS page, 'name' AS name_field,
  '{{"account":"' || account || '"' || CASE WHEN groups IS NULL THEN '' WHEN len(groups) = 0 THEN ',"groups":[]'
    ELSE ',"groups":["' || array_to_string(groups, '","') || '"]' END || ',"name":"' || name || '","node_count":'
    || CAST(node_count AS VARCHAR) || coalesce(',"status":"' || status || '"', '') || '}}' AS row, NULL AS reason FROM cust
UNION ALL SELECT 'gcp', 'suppliers', 's.html', 's_name', '{{"s_name":"' || s_name || '","s_nationkey":'
  || CAST(s_nationkey AS VARCHAR) || ',"s_suppkey":' || CAST(s_suppkey AS VARCHAR) || '}}', NULL FROM supplier
UNION ALL SELECT 'gcp', 'suppliers', NULL, NULL, '{{"s_suppkey": 0, "s_name"', 'not a JSON object'
UNION ALL SELECT 'gcp', 'broken', NULL, NULL, '[{{"name": "cut sh' || chr(10), 'not a JSON array'
UNION ALL SELECT 'aws', 'missing', NULL, NULL, NULL, 'missing'""",
    "f9_envelope": f"""WITH {CUST_CTE}
SELECT 'aws' AS provider, 'customers' AS service, 'c.html' AS page, name, account, '' AS region,
  CASE WHEN status = 'active' THEN 'active' ELSE 'removed' END AS status_class, coalesce(status, 'unknown') AS status_text
FROM cust WHERE contains(lower(account), '00000') OR contains(lower(name), '00000') OR coalesce(contains(lower(status), '00000'), false)
UNION ALL SELECT 'gcp', 'suppliers', 's.html', s_name, '-', '', 'removed', 'unknown' FROM supplier WHERE contains(lower(s_name), '00000')""",
    "s3_read_snapshot": MQ.SQL["m1_merge_domains"],
    "s5_read_landed": NQ.SQL["n1_godaddy_domains"],
    "k1_export_domains": f"""WITH {_DOM_S} SELECT domain, registrar, status, strftime(expiry_date, '%Y-%m-%d') AS expiry_date,
  strftime(discovery_date, '%Y-%m-%d') AS discovery_date, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM s""",
    "k2_export_dns": f"""WITH {_DNS_S} SELECT domain, subdomain, type, data, source, status,
  strftime(discovery_date, '%Y-%m-%d') AS discovery_date, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM r""",
    "k3_export_removed": UQ.SQL["u1_removed_assets"],
    "k4_update_metadata": "WITH " + META + f""", {_DOM_S}, {_DNS_S}
SELECT provider_key, name, provider, schedule, provider_last_updated, service, last_updated,
  CAST(count AS BIGINT) AS count FROM meta
UNION ALL SELECT 'dns', 'DNS', 'GoDaddy/Cloudflare', 'daily', '{EXPORT_NOW}', 'domains', '{EXPORT_NOW}',
  (SELECT CAST(count(*) AS BIGINT) FROM s)
UNION ALL SELECT 'dns', 'DNS', 'GoDaddy/Cloudflare', 'daily', '{EXPORT_NOW}', 'subdomains', '{EXPORT_NOW}',
  (SELECT CAST(count(*) AS BIGINT) FROM r)""",
    "k5_export_csv": f"""WITH {CUST_CTE}
SELECT {" || ',' || ".join(_csv_cell(c) for c in _CSV_COLS)} AS value FROM cust
WHERE status IS DISTINCT FROM 'removed'
UNION ALL SELECT 'Account,Name,Note,Balance,Public,Groups,Status'""",
    "k6_commit_snapshot": f"SELECT 1 AS versions_apart, * FROM ({MQ.SQL['m2_merge_dns_records']})",
    "k6_commit_source_partition": MQ.SQL["m1_merge_domains"],
}


SQL["k7_export_all"] = f"""
SELECT 'domains' AS file, domain AS name, registrar AS provider, status AS value FROM ({SQL['k1_export_domains']})
UNION ALL SELECT 'subdomains', domain, source, status FROM ({SQL['k2_export_dns']})
UNION ALL SELECT 'removed', name, provider, removed_date FROM ({SQL['k3_export_removed']})
UNION ALL SELECT 'metadata', service, provider_key, last_updated FROM ({SQL['k4_update_metadata']})"""


# --- E1: collection runs end to end ----------------------------------------------
def _stores(spark, name: str) -> C.CollectionStores:
    base = _scratch(spark, name)
    return C.CollectionStores(S.SnapshotStore(spark, f"{base}/domains", "registrar", DOMAINS_DDL, "status"),
                              S.SnapshotStore(spark, f"{base}/records", "source", DNS_DDL, "status"), f"{base}/runs")


def _day(spark, stores, provider, domains, records, day, run_id, seq=1):
    return C.run_collection(spark, stores, provider, domains, records, day, f"{day} 06:00:00", run_id, seq)


_RUN = ["run_id", "collector_name", "status", "records_found", "records_added", "records_updated", "records_removed", "error_message"]


def _runs(spark, stores):
    return R.current_runs(C.read_run_log(spark, stores.run_log_dir)).select(*_RUN)


def e1_collection_run(spark, sf):
    stores = _stores(spark, "e1")
    out = _day(spark, stores, N.GODADDY, godaddy_domain_docs(spark, sf), NQ.godaddy_record_docs(spark, sf), N_AS_OF, "run-1")
    d, r = stores.domains.read().count(), stores.records.read().count()
    return out.select(
        "run_id", "collector_name", "status", "records_found", "records_added", "records_updated",
        "records_removed", F.lit(d).cast("long").alias("domains_in_snapshot"),
        F.lit(r).cast("long").alias("records_in_snapshot"))


def _two_days(spark, sf):
    """A collection of all pages and, a day later, one of two thirds of them."""
    stores = _stores(spark, "e1r")
    for day, where in ((N_AS_OF, "true"), (NEXT_DAY, CHANGED)):
        _day(spark, stores, N.GODADDY, godaddy_domain_docs(spark, sf, where), NQ.godaddy_record_docs(spark, sf, where), day, f"run-{day}")
    return stores


def e1_removals(spark, sf):
    """Records after a second collection that has fewer of them."""
    rows = _two_days(spark, sf).records.read()
    return X.finalize(rows.select("domain", "subdomain", "record_type", "data", "status", "discovery_date", "last_seen"))


def e1_removal_counts(spark, sf):
    """The run log's counters of both days, and the counts kept with the snapshots."""
    stores = _two_days(spark, sf)
    runs = _runs(spark, stores).select("run_id", *[F.col(f"records_{c}").cast("long").alias(c) for c in ("added", "updated", "removed")])
    both = stores.domains.counts().select(F.lit("domains").alias("run_id"), F.col("total").alias("added"), F.col("active").alias("updated"), "removed")
    return runs.unionByName(both).unionByName(
        stores.records.counts().select(F.lit("records").alias("run_id"), F.col("total").alias("added"), F.col("active").alias("updated"), "removed"))


def _failed_day(spark, stores, *day) -> None:
    try:
        _day(spark, stores, *day)
    except ValueError:
        return
    raise AssertionError("a run with a page that cannot be read must fail")


_REJECTED = '{"success":false,"errors":[{"code":1,"message":"rate limited"}]}'


def _zone_pages(spark, sf):
    docs = NQ.cloudflare_zone_docs(spark, sf)
    return docs.withColumn("value", F.regexp_replace("value", '"success":false', '"success":true'))


def e1_failed_zone_page(spark, sf):
    """A zone page is rejected on the second day: the run fails and the zones stay as they were."""
    stores = _stores(spark, "e1z")
    pages = _zone_pages(spark, sf)
    none = spark.createDataFrame([], "zone_id string, _doc long, value string")
    _day(spark, stores, N.CLOUDFLARE, pages, none, N_AS_OF, "run-1")
    bad = pages.where("_doc > 0").unionByName(spark.range(1).select(F.lit(0).cast("long").alias("_doc"), F.lit(_REJECTED).alias("value")))
    _failed_day(spark, stores, N.CLOUDFLARE, bad, none, NEXT_DAY, "run-2")
    active = stores.domains.read().where("status = 'active'").count()
    return _runs(spark, stores).withColumn("active", F.lit(active).cast("long"))


def e1_failed_record_page(spark, sf):
    """Record pages of some zones are rejected on the second day: their records are left alone."""
    stores = _stores(spark, "e1p")
    zones, pages = _zone_pages(spark, sf), NQ.cloudflare_record_docs(spark, sf)
    first = pages.withColumn("value", F.regexp_replace("value", '"success":false', '"success":true'))
    _day(spark, stores, N.CLOUDFLARE, zones, first, N_AS_OF, "run-1")
    _day(spark, stores, N.CLOUDFLARE, zones, pages, NEXT_DAY, "run-2")
    rows = stores.records.read().groupBy("domain", "status", "last_seen").agg(F.count(F.lit(1)).alias("records"))
    return X.finalize(rows)


def e1_bad_json(spark, sf):
    """A domain page that is cut short fails the run, which merges nothing and names the page."""
    stores = _stores(spark, "e1j")
    pages = godaddy_domain_docs(spark, sf)
    cut = pages.withColumn("value", F.when(F.col("_doc") == 0, F.substring("value", 1, 12)).otherwise(F.col("value")))
    _failed_day(spark, stores, N.GODADDY, cut, NQ.godaddy_record_docs(spark, sf), N_AS_OF, "run-1")
    return _runs(spark, stores).withColumn("stored", F.lit(stores.domains.read().count()).cast("long"))


def r2_retried_run(spark, sf):
    """A run that fails and is then run again under its name ends as completed."""
    stores = _stores(spark, "r2")
    pages = godaddy_domain_docs(spark, sf)
    cut = pages.withColumn("value", F.when(F.col("_doc") == 0, F.substring("value", 1, 12)).otherwise(F.col("value")))
    none = spark.createDataFrame([], "domain string, _doc long, value string")
    _failed_day(spark, stores, N.GODADDY, cut, none, N_AS_OF, "run-1")
    _day(spark, stores, N.GODADDY, pages, none, N_AS_OF, "run-1")
    events = C.read_run_log(spark, stores.run_log_dir).select("event_seq").distinct().count()
    return _runs(spark, stores).drop("error_message").withColumn("events", F.lit(events).cast("long"))


for _q in (e1_collection_run, e1_removals, e1_removal_counts, e1_failed_zone_page, e1_failed_record_page, e1_bad_json, r2_retried_run):
    QUERIES[_q.__name__] = _q

SQL["e1_collection_run"] = "WITH " + NQ.HOSTS + f""",
{NQ.kept('d')}, {NQ.records_of('r', 'd')}, rk AS (SELECT DISTINCT * FROM r)
SELECT 'run-1' AS run_id, 'godaddy' AS collector_name, 'completed' AS status,
  CAST((SELECT count(*) FROM d) + (SELECT count(*) FROM r) AS INTEGER) AS records_found,
  CAST((SELECT count(*) FROM d) + (SELECT count(*) FROM rk) AS INTEGER) AS records_added,
  CAST((SELECT count(*) FROM r) - (SELECT count(*) FROM rk) AS INTEGER) AS records_updated,
  0 AS records_removed,
  (SELECT count(*) FROM d) AS domains_in_snapshot, (SELECT count(*) FROM rk) AS records_in_snapshot"""
SQL["e1_removals"] = REMOVED_RECORDS
SQL["e1_removal_counts"] = f"""WITH dd AS ({REMOVED_DOMAINS}), rr AS ({REMOVED_RECORDS}),
n AS (WITH {NQ.HOSTS}, {NQ.kept('d1')}, {NQ.kept('d2', CHANGED)}, {NQ.records_of('r1', 'd1')}, {NQ.records_of('r2', 'd2', CHANGED)}
  SELECT (SELECT count(*) FROM d1) AS nd1, (SELECT count(*) FROM d2) AS nd2, (SELECT count(*) FROM r1) AS nr1, (SELECT count(*) FROM r2) AS nr2)
SELECT 'run-2024-02-01' AS run_id, (SELECT count(*) FROM dd) + (SELECT count(*) FROM rr) AS added,
  nd1 + nr1 - (SELECT count(*) FROM dd) - (SELECT count(*) FROM rr) AS updated, CAST(0 AS BIGINT) AS removed FROM n
UNION ALL SELECT 'run-2024-02-02', 0, nd2 + nr2, (SELECT count(*) FROM dd WHERE status = 'removed') + (SELECT count(*) FROM rr WHERE status = 'removed') FROM n
UNION ALL SELECT 'domains', count(*), count(*) FILTER (WHERE status = 'active'), count(*) FILTER (WHERE status = 'removed') FROM dd
UNION ALL SELECT 'records', count(*), count(*) FILTER (WHERE status = 'active'), count(*) FILTER (WHERE status = 'removed') FROM rr"""
_ALL_ZONES = NQ.ZONES.replace("_doc % 7 <> 3 AND ", "")
SQL["e1_failed_zone_page"] = "WITH " + _ALL_ZONES + """, n AS (SELECT CAST(count(*) AS INTEGER) AS n FROM zones)
SELECT 'run-1' AS run_id, 'cloudflare' AS collector_name, 'completed' AS status, n AS records_found, n AS records_added, 0 AS records_updated,
  0 AS records_removed, CAST(NULL AS VARCHAR) AS error_message, CAST(n AS BIGINT) AS active FROM n
UNION ALL SELECT 'run-2', 'cloudflare', 'failed', 0, 0, 0, 0, 'domain page failed: rate limited', CAST(n AS BIGINT) FROM n"""
SQL["e1_failed_record_page"] = "WITH " + _ALL_ZONES + ", " + NQ.RECS.replace(" FROM rs WHERE zk % 10 <> 7)", " FROM rs)") + f""",
k AS (SELECT DISTINCT zone_name AS domain, zk, {NQ._extract('name', 'zone_name')} AS subdomain, {NQ._rtype('type')} AS record_type, content FROM rj)
SELECT domain, 'active' AS status, CASE WHEN zk % 10 = 7 THEN '2024-02-01' ELSE '2024-02-02' END AS last_seen, CAST(count(*) AS BIGINT) AS records
FROM k GROUP BY 1, 2, 3"""
SQL["e1_bad_json"] = """SELECT 'run-1' AS run_id, 'godaddy' AS collector_name, 'failed' AS status, 0 AS records_found, 0 AS records_added,
  0 AS records_updated, 0 AS records_removed, 'domain page failed: not a JSON array: [{"domain":" (page {"_doc":0})' AS error_message,
  CAST(0 AS BIGINT) AS stored"""
SQL["r2_retried_run"] = "WITH " + NQ.HOSTS + f""", {NQ.kept('d')}, n AS (SELECT CAST(count(*) AS INTEGER) AS n FROM d)
SELECT 'run-1' AS run_id, 'godaddy' AS collector_name, 'completed' AS status, n AS records_found, n AS records_added, 0 AS records_updated,
  0 AS records_removed, CAST(4 AS BIGINT) AS events FROM n"""


# --- K6 on a bucketed snapshot: the snapshot side of the merge never shuffles ----
def k6_bucketed_merge(spark, sf):
    from skyledger.schemas import DNS_KEY
    name = f"dns_snap_{uuid.uuid4().hex[:10]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = S.BucketedSnapshot(spark, _scratch(spark, "k6b"), name, DNS_KEY[:4], buckets, partition_by="source")
    store.commit(X.dns_snapshot(spark, sf))
    m = M.merge_dns_records(store.read(), X.dns_batch(spark, sf), X.DNS_SOURCE, X.DNS_AS_OF, X.DNS_NOW)
    store.commit(m.snapshot)
    return X.finalize(store.read())


QUERIES["k6_bucketed_merge"] = k6_bucketed_merge
SQL["k6_bucketed_merge"] = MQ.SQL["m2_merge_dns_records"]


# --- S3 bootstrap: an inventory loaded back from its own JSON exports -----------
def s3_bootstrap_from_exports(spark, sf):
    path = _scratch(spark, "boot")
    K.export_dns(X.dns_snapshot(spark, sf), path)
    snap = S.read_dns_json(spark, path)
    return X.finalize(snap.select("domain", "subdomain", "record_type", "data", "source", "status",
                                  "discovery_date", "last_seen"))


QUERIES["s3_bootstrap_from_exports"] = s3_bootstrap_from_exports
SQL["s3_bootstrap_from_exports"] = f"""WITH {_DNS_S} SELECT domain, subdomain, type AS record_type, data, source,
  status, strftime(discovery_date, '%Y-%m-%d') AS discovery_date, strftime(last_seen, '%Y-%m-%d') AS last_seen FROM r"""

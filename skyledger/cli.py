"""Command-line jobs (``python -m skyledger <command>`` or spark-submit).

The reference is driven through HTTP endpoints and web pages; each maps to a
Spark job here:

  sync      landed GoDaddy/Cloudflare pages -> merged snapshots + run log   (POST /sync/trigger)
  status    latest run and running flag per collector                        (GET /sync/status)
  repair    mark runs still running after --max-age-hours as failed           (stale-lock cleanup)
  export    domains / records / removed / metadata JSON                       (export)
  domains   filtered domain list, written as JSON                             (GET /domains)
  records   filtered DNS record list, written as JSON                         (GET /dns-records)
  view      one page of a catalog view over an asset table                    (table pages)
  rank      sort a view once into a rank index                                 (table pages)
  page      any page of a rank index                                           (table pages)
  removed   removed assets of a provider's services, or of one in its columns (removed pages)
  freshness age of every service's data                                       (freshness badges)
  index     build the provider-partitioned search index from asset files      (search page data)
  search    search the index: per-service counts and first hits               (search page)

Printed output is a page, ten hits per service or one row per collector, fetched
one partition at a time; full results are written by the executors.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from skyledger.catalog import REMOVED_VIEWS, VIEWS, search_manifest
from skyledger.collection import CollectionStores, read_run_log, run_collection
from skyledger.operators import ranking
from skyledger.operators import runs as R
from skyledger.operators import unify as U
from skyledger.operators import views as V
from skyledger.schemas import DNS_DDL, DOMAINS_DDL
from skyledger.session import get_session
from skyledger.sources import envelope as E
from skyledger.sources import readers as S
from skyledger.sources import sinks as K


def _stores(spark, base: str) -> CollectionStores:
    return CollectionStores(S.SnapshotStore(spark, f"{base}/domains", "registrar", DOMAINS_DDL, "status"),
                            S.SnapshotStore(spark, f"{base}/records", "source", DNS_DDL, "status"), f"{base}/runs")


def _print(df, limit: int | None = None) -> None:
    for row in (df if limit is None else df.limit(limit)).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))


def cmd_sync(spark, a) -> None:
    stores = _stores(spark, a.store)
    domains = S.read_landed(spark, a.landed_domains, lines=a.lines)
    records = S.read_landed(spark, a.landed_records, lines=a.lines)
    path = F.col("_doc.file") if a.lines else F.col("_doc")
    key = "domain" if a.provider == "GoDaddy" else "zone_id"
    records = records.withColumn(key, F.regexp_extract(path, key + r"=([^/]+)", 1))
    as_of = a.as_of or spark.range(1).select(F.current_date().cast("string")).first()[0]
    now = a.now or f"{as_of} 00:00:00"
    log = read_run_log(spark, stores.run_log_dir)
    seq = (log.agg(F.max("event_seq")).first()[0] or 0) + 1
    out = run_collection(spark, stores, a.provider, domains, records, as_of, now, a.run_id or f"run-{seq}", seq,
                         trigger=a.trigger)
    _print(out, 1)
    if a.export:  # a successful run publishes its results
        export_all(spark, stores, a.export, now, a.metadata)


def cmd_status(spark, a) -> None:
    runs = R.current_runs(read_run_log(spark, f"{a.store}/runs"))
    _print(R.collector_status(runs).orderBy("collector_name"))


def cmd_repair(spark, a) -> None:
    path = f"{a.store}/runs"
    log = read_run_log(spark, path)
    runs = R.current_runs(log)
    base = (log.agg(F.max("event_seq")).first()[0] or 0) + 1
    events = R.repair_events(runs, a.now, base, a.max_age_hours).select(*R.RUN_COLUMNS)
    events.write.mode("append").parquet(path)
    _print(R.stale_count(runs, a.now, a.max_age_hours), 1)


def export_all(spark, stores: CollectionStores, out: str, now: str, metadata: str | None) -> None:
    meta = (R.read_metadata(spark, metadata) if metadata else
            spark.createDataFrame([], "provider_key string, name string, provider string, schedule string, "
                                      "provider_last_updated string, service string, last_updated string, "
                                      "count bigint"))
    K.export_all(stores.domains.read(), stores.records.read(), meta, out, now, document=True)


def cmd_export(spark, a) -> None:
    export_all(spark, _stores(spark, a.store), a.out, a.now, a.metadata)


def cmd_domains(spark, a) -> None:
    K.domains_export_frame(V.get_domains(_stores(spark, a.store).domains.read(), a.status or "",
                                         a.source or "")).write.mode("overwrite").json(a.out)


def cmd_records(spark, a) -> None:
    recs = _stores(spark, a.store).records.read()
    out = V.get_dns_records(recs, a.status or "", a.source or "", a.domain or "")
    out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if c in ("discovery_date", "last_seen") else F.col(c)
                 for c in out.columns]).write.mode("overwrite").json(a.out)


def cmd_rank(spark, a) -> None:
    """Sort a view once into a rank index, from which ``page`` reads any page."""
    df, view = V.not_removed(S.read_assets(spark, a.data)), VIEWS[a.view]
    order = V.smart_order(df, view.columns[a.sort_col].data, "desc" if a.desc else "asc")
    ranking.build_rank_index(df, order, a.out, a.ranges)


def cmd_page(spark, a) -> None:
    rows = ranking.page_by_rank(spark, a.index, a.page, a.rows, position="_position")
    view = VIEWS[a.view]
    _print(V.project_view(rows, view, keep=["_position"]).orderBy("_position"), a.rows)
    _print(ranking.rank_summary(spark, a.index, a.page, a.rows), 1)


def cmd_view(spark, a) -> None:
    df = S.read_assets(spark, a.data)
    view = VIEWS[a.view]
    filters = dict(f.split("=", 1) for f in (a.filter or []))
    page = V.table_view(df, view, account=a.account, search=a.search, column_filters=filters,
                        sort_col=a.sort_col, direction="desc" if a.desc else "asc", page_no=a.page, rows=a.rows,
                        hidden=[int(x) for x in (a.hide or "").split(",") if x])
    if a.summary:
        by_name = {view.columns[int(k)].data if k.isdigit() else k: v for k, v in filters.items()}
        filtered = V.filter_columns(V.search_rows(V.filter_account(V.not_removed(df), a.account), a.search, view),
                                    by_name)
        _print(V.page_summary(filtered, a.page, a.rows), 1)
        _print(V.status_stats(df), 1)
    if a.rows == -1:  # every row, fetched one partition at a time
        for line in page.toJSON().toLocalIterator():
            print(line)
    else:
        _print(page, a.rows)


def cmd_removed(spark, a) -> None:
    """Removed assets of one service in its own columns, or of a provider's services in the common ones."""
    lists = REMOVED_VIEWS[a.provider]
    keys = [a.service] if a.service else list(lists)
    entries = [S.CatalogEntry(a.provider, k, f"{a.data_dir.rstrip('/')}/{lists[k].source}.json") for k in keys]
    services, skipped = S.read_catalog(spark, entries)
    if not services:
        _print(skipped)
    elif a.service:
        _print(U.removed_service(services[0].df, lists[a.service], a.date_from, a.date_to), a.rows)
    else:
        _print(U.removed_unified(services, a.provider, a.date_from, a.date_to), a.rows)


def cmd_freshness(spark, a) -> None:
    """Age of every service's data (``--now``, else the time of the call)."""
    now = a.now or F.current_timestamp()
    _print(R.freshness_report(R.read_metadata(spark, a.metadata), now).orderBy("provider_key", "service"), a.rows)


def cmd_index(spark, a) -> None:
    found = E.read_envelope(spark, search_manifest(a.data_dir))
    E.envelope_index(found.rows).write.mode("overwrite").partitionBy("provider").parquet(a.out)
    _print(found.errors.select("provider", "service", F.col("_file").alias("path"), "reason"))


def cmd_search(spark, a) -> None:
    hits = U.search_index(spark.read.parquet(a.index), a.q, a.providers.split(",") if a.providers else None)
    _print(U.search_totals(hits), 1)
    _print(U.top_hits(hits, 10).orderBy("provider", "service", "rank"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skyledger")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("sync")
    s.add_argument("--provider", choices=["GoDaddy", "Cloudflare"], required=True)
    s.add_argument("--landed-domains", required=True)
    s.add_argument("--landed-records", required=True,
                   help="record pages under .../domain=<name>/ (GoDaddy) or .../zone_id=<id>/ (Cloudflare)")
    s.add_argument("--lines", action="store_true", help="one response per line instead of one per file")
    s.add_argument("--store", required=True)
    s.add_argument("--as-of")
    s.add_argument("--now")
    s.add_argument("--run-id")
    s.add_argument("--trigger", default="manual")
    s.add_argument("--export", help="folder to export to after a successful run")
    s.add_argument("--metadata", help="metadata to update in the export")
    s = sub.add_parser("status")
    s.add_argument("--store", required=True)
    s = sub.add_parser("repair")
    s.add_argument("--store", required=True)
    s.add_argument("--now", required=True)
    s.add_argument("--max-age-hours", type=float, default=R.STALE_MAX_AGE_HOURS)
    s = sub.add_parser("export")
    s.add_argument("--store", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--now", required=True)
    s.add_argument("--metadata")
    for name in ("domains", "records"):
        s = sub.add_parser(name)
        s.add_argument("--store", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--status")
        s.add_argument("--source")
        if name == "records":
            s.add_argument("--domain")
    s = sub.add_parser("view")
    s.add_argument("--data", required=True)
    s.add_argument("--view", required=True, choices=sorted(VIEWS))
    s.add_argument("--account")
    s.add_argument("--search")
    s.add_argument("--filter", action="append", help="field=text, repeatable")
    s.add_argument("--sort-col", type=int, default=0)
    s.add_argument("--desc", action="store_true")
    s.add_argument("--page", type=int, default=0)
    s.add_argument("--rows", type=int, default=50, choices=list(V.ALLOWED_PAGE_SIZES))
    s.add_argument("--hide", help="column positions to hide, e.g. 0,3 (still searched)")
    s.add_argument("--summary", action="store_true", help="first print page bounds and status counts")
    s = sub.add_parser("rank")
    s.add_argument("--data", required=True)
    s.add_argument("--view", required=True, choices=sorted(VIEWS))
    s.add_argument("--sort-col", type=int, default=0)
    s.add_argument("--desc", action="store_true")
    s.add_argument("--out", required=True)
    s.add_argument("--ranges", type=int, help="about one for each million rows")
    s = sub.add_parser("page")
    s.add_argument("--index", required=True)
    s.add_argument("--view", required=True, choices=sorted(VIEWS))
    s.add_argument("--page", type=int, default=0)
    s.add_argument("--rows", type=int, default=50)
    s = sub.add_parser("removed")
    s.add_argument("--data-dir", required=True)
    s.add_argument("--provider", required=True, choices=sorted(REMOVED_VIEWS))
    s.add_argument("--service")
    s.add_argument("--from", dest="date_from")
    s.add_argument("--to", dest="date_to")
    s.add_argument("--rows", type=int, default=50)
    s = sub.add_parser("freshness")
    s.add_argument("--metadata", required=True)
    s.add_argument("--now")
    s.add_argument("--rows", type=int, default=250)
    s = sub.add_parser("index")
    s.add_argument("--data-dir", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("search")
    s.add_argument("--index", required=True)
    s.add_argument("--q", required=True)
    s.add_argument("--providers")
    return p


COMMANDS = {"sync": cmd_sync, "status": cmd_status, "repair": cmd_repair, "export": cmd_export,
            "domains": cmd_domains, "records": cmd_records, "view": cmd_view, "index": cmd_index,
            "search": cmd_search, "removed": cmd_removed, "rank": cmd_rank, "page": cmd_page, "freshness": cmd_freshness}


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or get_session(a.master)
    COMMANDS[a.cmd](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])

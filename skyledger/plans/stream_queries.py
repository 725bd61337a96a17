"""Registered incremental (Structured Streaming) queries.

GoDaddy domain and record pages derived from ``pages`` land as envelope
lines on two days (the whole fetch each day, the second of two thirds of the
pages); an ``AvailableNow`` stream runs one collection per micro-batch. The
results are the final committed domain and record snapshots. ``st3`` lands the
second day in pieces, its end marker first, and one fetch that never ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyledger.collection import CollectionStores
from skyledger.plans import fixtures as X
from skyledger.plans.normalize_queries import (AS_OF, HOSTS, SQL as NSQL, godaddy_domain_docs, godaddy_record_docs,
                                               kept, records_of)
from skyledger.schemas import DNS_DDL, DOMAINS_DDL
from skyledger.session import scratch_path
from skyledger.sources.readers import SnapshotStore
from skyledger.streaming.incremental import IncrementalSync, envelope_lines

NEXT_DAY = "2024-02-02"


CHANGED = "page_id % 3 <> 0"  # pages that the second day still has


def _job(spark, pending: bool = False) -> tuple[str, IncrementalSync, dict]:
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex[:12]}")
    day = {"as_of": AS_OF}
    stores = CollectionStores(SnapshotStore(spark, f"{base}/domains", "registrar", DOMAINS_DDL),
                              SnapshotStore(spark, f"{base}/records", "source", DNS_DDL), f"{base}/runs")
    return base, IncrementalSync(f"{base}/landed", stores, f"{base}/ckpt", as_of=lambda: day["as_of"],
                                 pending=f"{base}/pending" if pending else None), day


def _lines(spark, sf, where: str = "true", fetch: str | None = None):
    return envelope_lines(godaddy_domain_docs(spark, sf, where), "domains", fetch).unionByName(
        envelope_lines(godaddy_record_docs(spark, sf, where), "records", fetch))


def _run_two_days(spark, sf) -> IncrementalSync:
    base, job, day = _job(spark)
    _lines(spark, sf).write.text(f"{base}/landed/day1")            # day 1: the full fetch lands and is merged
    job.start(spark).awaitTermination()
    day["as_of"] = NEXT_DAY
    _lines(spark, sf, CHANGED).write.text(f"{base}/landed/day2")   # day 2: the next fetch; only new files are read
    job.start(spark).awaitTermination()
    return job


def st3_fetch_in_pieces(spark, sf):
    """Domains after a fetch whose end marker landed before its pages, beside one that never ends."""
    base, job, day = _job(spark, pending=True)
    pieces = _lines(spark, sf, fetch="f1")
    n = pieces.count()
    end = F.to_json(F.struct(F.lit("end").alias("kind"), F.lit("f1").alias("fetch"), F.lit(n).alias("pages"))).alias("value")
    spark.range(1).select(end).write.text(f"{base}/landed/0")
    _lines(spark, sf, "page_id < 50", fetch="open").write.text(f"{base}/landed/1")
    job.start(spark).awaitTermination()
    before = job.domains().count()
    pieces.write.text(f"{base}/landed/2")
    job.start(spark).awaitTermination()
    return X.finalize(job.domains().select("domain", "registrar", "status", "discovery_date", "last_seen")).withColumn(
        "before", F.lit(before).cast("long"))


def st1_incremental_sync(spark, sf):
    job = _run_two_days(spark, sf)
    return X.finalize(job.domains().select("domain", "registrar", "status", "discovery_date", "last_seen"))


def st2_incremental_records(spark, sf):
    job = _run_two_days(spark, sf)
    runs = job.run_log(spark).count()
    return X.finalize(job.records().select("domain", "subdomain", "record_type", "data", "status",
                                           "discovery_date", "last_seen")).withColumn("runs", F.lit(runs).cast("long"))


QUERIES = {"st1_incremental_sync": st1_incremental_sync, "st2_incremental_records": st2_incremental_records,
           "st3_fetch_in_pieces": st3_fetch_in_pieces}

_N1 = NSQL["n1_godaddy_domains"]
# the second day's removals: domains that no page lists any more, and records of domains that still have some
REMOVED_DOMAINS = "WITH " + HOSTS + f""", {kept('d1')}, {kept('d2', CHANGED)}
SELECT domain, 'GoDaddy' AS registrar, CASE WHEN domain IN (SELECT domain FROM d2) THEN 'active' ELSE 'removed' END AS status,
  '2024-02-01' AS discovery_date, CASE WHEN domain IN (SELECT domain FROM d2) THEN '2024-02-02' ELSE '2024-02-01' END AS last_seen FROM d1"""
REMOVED_RECORDS = "WITH " + HOSTS + f""", {kept('d1')}, {kept('d2', CHANGED)}, {records_of('r1', 'd1')}, {records_of('r2', 'd2', CHANGED)},
k1 AS (SELECT DISTINCT * FROM r1), k2 AS (SELECT DISTINCT *, true AS seen FROM r2)
SELECT domain, subdomain, record_type, data,
  CASE WHEN seen OR domain NOT IN (SELECT domain FROM r2) THEN 'active' ELSE 'removed' END AS status,
  '2024-02-01' AS discovery_date, CASE WHEN seen THEN '2024-02-02' ELSE '2024-02-01' END AS last_seen
FROM k1 LEFT JOIN k2 USING (domain, subdomain, record_type, data)"""
SQL = {
    "st1_incremental_sync": REMOVED_DOMAINS,
    "st2_incremental_records": f"SELECT *, CAST(2 AS BIGINT) AS runs FROM ({REMOVED_RECORDS})",
    "st3_fetch_in_pieces": "SELECT domain, registrar, status, discovery_date, last_seen, CAST(0 AS BIGINT) AS before FROM (" + _N1 + ")",
}

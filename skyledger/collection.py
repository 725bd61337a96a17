"""One collection run end to end (the sync entry point).

landed responses -> normalise (N1-N4) -> merge domains and records (M6) ->
commit the merged source partitions (K6) -> run log open/close (R1, R2) ->
optional exports (K7). The counters of a merge (a handful of numbers) are taken
while its version is written; no rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import merge as M
from skyledger.operators import normalize as N
from skyledger.operators import runs as R
from skyledger.schemas import RUN_LOG_DDL
from skyledger.sources import claims
from skyledger.sources import readers as S


class RunInProgress(RuntimeError):
    """Another run of the same collector is running."""


@dataclass
class CollectionStores:
    domains: S.SnapshotStore      # partitioned by registrar
    records: S.SnapshotStore      # partitioned by source
    run_log_dir: str              # append-only run events (Parquet)


def _append(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c) for c in R.RUN_COLUMNS]).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    if not S.path_exists(spark, path):
        return spark.createDataFrame([], RUN_LOG_DDL)
    return spark.read.parquet(path)


def _next_seq(log: DataFrame, run_id: str, at_least: int) -> int:
    """The next free event number of a run: an attempt's events come after all of the earlier attempts'."""
    last = log.filter(F.col("run_id") == run_id).agg(F.max("event_seq")).first()[0]
    return at_least if last is None else max(at_least, last + 1)


def _claims(stores: CollectionStores, collector: str) -> str:
    return f"{stores.run_log_dir.rstrip('/')}_claims/{collector}"


def _claim(spark: SparkSession, stores: CollectionStores, collector: str, run_id: str) -> bool:
    """Whether ``run_id`` may run: one run of a collector at a time, however many sessions try."""

    def is_over(holder: str) -> bool | None:
        state = R.current_runs(read_run_log(spark, stores.run_log_dir).filter(F.col("run_id") == holder)).select("status").first()
        return None if state is None else state["status"] != "running"

    return claims.take_turn(spark, _claims(stores, collector), run_id, is_over)


def _closing(spark: SparkSession, run_id: str, collector: str, now: str, trigger: str, seq: int, counts: dict[str, int],
             error: str | None = None) -> DataFrame:
    at = F.current_timestamp() if error is None else F.lit(now).cast("timestamp")
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(collector).alias("collector_name"), F.lit("dns").alias("service_type"),
        F.lit("completed" if error is None else "failed").alias("status"), F.lit(now).cast("timestamp").alias("started_at"),
        at.alias("completed_at"), *[F.lit(counts.get(c, 0)).cast("int").alias(f"records_{c}") for c in ("found", "added", "updated", "removed")],
        F.lit(error).cast("string").alias("error_message"), F.lit(trigger).alias("trigger_type"), F.lit(seq).cast("long").alias("event_seq"))


def fail_run(spark: SparkSession, stores: CollectionStores, provider: str, run_id: str, now: str, error: str,
             trigger: str = "scheduled") -> None:
    """Log ``run_id`` as failed without having run; a run that has ended keeps its state."""
    log = read_run_log(spark, stores.run_log_dir)
    state = R.current_runs(log.filter(F.col("run_id") == run_id)).select("status").first()
    if state is None or state["status"] == "running":
        _append(_closing(spark, run_id, provider.lower(), now, trigger, _next_seq(log, run_id, 0), {}, error), stores.run_log_dir)


def _batches(provider: str, domain_docs: DataFrame, record_docs: DataFrame, as_of: str):
    """(domains, records, frames to release after the run).

    A rejected or unreadable domain page fails the run: merging the rest would
    mark its domains removed. A rejected record page leaves all records of its
    domain (or zone) out of the batch, so that domain is not touched. Records
    are those of the domains that are kept (N5)."""
    failed = N.rejected_pages(domain_docs, provider).select("error").take(1)
    if failed:
        raise ValueError(f"domain page failed: {failed[0]['error']}")
    key = "zone_id" if provider == N.CLOUDFLARE else "domain"
    record_docs = record_docs.join(N.rejected_pages(record_docs, provider).select(key).distinct(), key, "left_anti")
    if provider == N.GODADDY:
        domains = N.normalize_godaddy_domains(domain_docs, as_of).persist(StorageLevel.MEMORY_AND_DISK)
        return domains, N.normalize_godaddy_records(N.of_kept_domains(record_docs, domains), as_of), [domains]
    if provider == N.CLOUDFLARE:
        # zones feed both the domain merge and the record join: parse them once
        zones = N.normalize_cloudflare_zones(domain_docs, as_of).persist(StorageLevel.MEMORY_AND_DISK)
        return zones, N.normalize_cloudflare_records(record_docs, zones, as_of), [zones]
    raise ValueError(f"unknown provider {provider}")


def _merged(store: S.SnapshotStore, provider: str, run_id: str, batch: DataFrame, merge) -> dict[str, int]:
    """Merge ``batch`` and commit it; M3's counts come from the pass that writes the version.

    An empty batch (counted on the way, not ahead) is never merged: it would remove everything."""
    if batch.isEmpty():
        return {}
    version = store.reserve(provider, run_id)
    if not store.is_committed(provider, version):
        result = merge(store.read(before=version, only=provider))
        store.commit(result.joined, provider, version, M.stat_columns())
    kept = store.kept(provider, version)
    if kept is None or "m_found" not in kept:  # committed by a run that kept no counts
        found = merge(store.read(before=version, only=provider)).joined.agg(*[c.alias(f"m_{k}") for k, c in M.stat_columns().items()])
        kept = {k: int(v or 0) for k, v in found.first().asDict().items()}
    return {k[2:]: v for k, v in kept.items() if k.startswith("m_")}


def run_collection(spark: SparkSession, stores: CollectionStores, provider: str, domain_docs: DataFrame,
                   record_docs: DataFrame, as_of: str, now: str, run_id: str, event_seq: int,
                   trigger: str = "scheduled", checked_domains: DataFrame | None = None) -> DataFrame:
    """Run one collection of ``provider`` from its landed pages and return
    the closing run-log event (one row). Each store records the version that
    ``run_id`` commits and merges from older versions only, so running the
    same collection again is idempotent. Refused (``RunInProgress``, nothing
    logged) while another run of the collector is running, in this session or
    any other: the collector is claimed before the log is written. A failed run
    is logged with the counts it reached."""
    collector = provider.lower()
    if not _claim(spark, stores, collector, run_id):
        raise RunInProgress(f"a run of {collector} is running")
    log = read_run_log(spark, stores.run_log_dir)
    seq = _next_seq(log, run_id, event_seq)
    opening = R.open_event_if_free(log, run_id, collector, "dns", trigger, now, seq)
    if opening.isEmpty():
        claims.give_back(spark, _claims(stores, collector), run_id)
        raise RunInProgress(f"a run of {collector} is running")
    _append(opening, stores.run_log_dir)
    held: list[DataFrame] = []
    total: dict[str, int] = {}

    def add(counts: dict[str, int]) -> None:
        for k, v in counts.items():
            total[k] = total.get(k, 0) + v

    try:
        dom, rec, held = _batches(provider, domain_docs, record_docs, as_of)
        dom = dom.select("domain", "expiry_date", "raw_data", "_ordinal")
        rec = rec.select("domain", "subdomain", "record_type", "data", "ttl", "priority", "raw_data", "_ordinal").persist(
            StorageLevel.MEMORY_AND_DISK)  # parsed once, read by the merge and its removal scope
        held = held + [rec]
        add(_merged(stores.domains, provider, run_id, dom, lambda old: M.merge_domains(old, dom, provider, as_of, now)))
        add(_merged(stores.records, provider, run_id, rec,
                    lambda old: M.merge_dns_records(old, rec, provider, as_of, now, checked_domains)))
        _append(_closing(spark, run_id, collector, now, trigger, seq + 1, total), stores.run_log_dir)
    except Exception as exc:  # the failure is recorded as the run's state
        _append(_closing(spark, run_id, collector, now, trigger, seq + 1, total, str(exc) or type(exc).__name__), stores.run_log_dir)
        raise
    finally:
        for df in held:
            df.unpersist()
    runs = R.current_runs(read_run_log(spark, stores.run_log_dir))
    return runs.filter(F.col("run_id") == run_id)


def compact_run_log(spark: SparkSession, path: str, new_path: str) -> None:
    """Rewrite the event log as one event per run (its current state) into
    ``new_path``; point the stores' ``run_log_dir`` there afterwards."""
    R.current_runs(read_run_log(spark, path)).select(*R.RUN_COLUMNS).write.mode("errorifexists").parquet(new_path)

"""Collector run log and data freshness.

The log is append-only: opening a run, closing it and repairing a stale run
each append one event row carrying the whole run state and a growing
``event_seq``; the state of a run is its latest event. Appends scale and
survive retries; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.schemas import RUN_LOG_DDL

RUN_COLUMNS = ["run_id", "collector_name", "service_type", "status", "started_at", "completed_at",
               "records_found", "records_added", "records_updated", "records_removed",
               "error_message", "trigger_type", "event_seq"]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
STALE_MESSAGE = "Process terminated unexpectedly"
STALE_MAX_AGE_HOURS = 2
# Freshness thresholds in hours per schedule: (fresh up to, stale up to);
# an unknown schedule uses the daily pair.
FRESHNESS_HOURS = {"hourly": (2, 4), "daily": (26, 50), "weekly": (168, 336)}
# ---------------------------------------------------------------------------


def _ts(v) -> Column:
    return v.cast("timestamp") if isinstance(v, Column) else F.lit(str(v)).cast("timestamp")


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RUN_LOG_DDL)


# R1 -------------------------------------------------------------------------
def open_run(log: DataFrame, run_id: str, collector: str, service_type: str, trigger: str,
             now, event_seq: int) -> DataFrame:
    """Append a ``running`` event."""
    spark = log.sparkSession
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(collector).alias("collector_name"),
        F.lit(service_type).alias("service_type"), F.lit("running").alias("status"),
        _ts(now).alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"),
        *[F.lit(None).cast("int").alias(c) for c in
          ["records_found", "records_added", "records_updated", "records_removed"]],
        F.lit(None).cast("string").alias("error_message"), F.lit(trigger).alias("trigger_type"),
        F.lit(event_seq).cast("long").alias("event_seq"))
    return log.unionByName(row)


def open_run_if_free(log: DataFrame, run_id: str, collector: str, service_type: str, trigger: str,
                     now, event_seq: int) -> DataFrame:
    """``open_run``, refused (no event) while another run of the collector is
    ``running``; the run's own earlier attempt does not count."""
    return log.unionByName(open_event_if_free(log, run_id, collector, service_type, trigger, now, event_seq))


def open_event_if_free(log: DataFrame, run_id: str, collector: str, service_type: str, trigger: str,
                       now, event_seq: int) -> DataFrame:
    """The ``running`` event alone; empty when the run is refused."""
    running = current_runs(log.filter(F.col("collector_name") == collector)).filter(
        (F.col("status") == "running") & (F.col("run_id") != run_id))
    event = open_run(log.limit(0), run_id, collector, service_type, trigger, now, event_seq)
    return event.join(running.select("collector_name"), "collector_name", "left_anti").select(*log.columns)


def current_runs(log: DataFrame) -> DataFrame:
    """State of every run = its latest event (partial aggregation per run)."""
    payload = [c for c in RUN_COLUMNS if c != "run_id"]
    return (log.groupBy("run_id")
            .agg(F.max_by(F.struct(*payload), F.col("event_seq")).alias("_r"))
            .select("run_id", "_r.*"))


# R2 -------------------------------------------------------------------------
def close_run(log: DataFrame, run_id: str, found: int, added: int, updated: int, removed: int,
              error: str | None, now, event_seq: int) -> DataFrame:
    """Append the closing event of ``run_id``: completed (``error`` is None), or
    failed with the whole error message (which may be empty); counters and
    completion time set."""
    cur = current_runs(log.filter(F.col("run_id") == run_id))
    closing = cur.select(
        "run_id", "collector_name", "service_type",
        F.lit("completed" if error is None else "failed").alias("status"), "started_at",
        _ts(now).alias("completed_at"),
        F.lit(found).cast("int").alias("records_found"), F.lit(added).cast("int").alias("records_added"),
        F.lit(updated).cast("int").alias("records_updated"),
        F.lit(removed).cast("int").alias("records_removed"),
        F.lit(error).cast("string").alias("error_message"), "trigger_type",
        F.lit(event_seq).cast("long").alias("event_seq"))
    return log.unionByName(closing)


# R3 -------------------------------------------------------------------------
def stale_filter(runs: DataFrame, now, max_age_hours: float = STALE_MAX_AGE_HOURS) -> Column:
    cutoff = F.unix_micros(_ts(now)) - F.lit(int(max_age_hours * 3_600_000_000))
    return (F.col("status") == "running") & (F.unix_micros(F.col("started_at")) < cutoff)


def repair_stale(runs: DataFrame, now, max_age_hours: float = STALE_MAX_AGE_HOURS) -> DataFrame:
    """Runs still ``running`` that started before now - max_age become
    failed with the fixed message (run state frame in, run state frame out)."""
    stale = stale_filter(runs, now, max_age_hours)
    return runs.select(
        *[F.when(stale, F.lit("failed")).otherwise(F.col(c)).alias(c) if c == "status" else
          F.when(stale, _ts(now)).otherwise(F.col(c)).alias(c) if c == "completed_at" else
          F.when(stale, F.lit(STALE_MESSAGE)).otherwise(F.col(c)).alias(c) if c == "error_message" else
          F.col(c) for c in runs.columns])


def repair_events(runs: DataFrame, now, event_seq_base: int,
                  max_age_hours: float = STALE_MAX_AGE_HOURS) -> DataFrame:
    """The repair as events to append (one per stale run)."""
    stale = runs.filter(stale_filter(runs, now, max_age_hours))
    return repair_stale(stale, now, max_age_hours).withColumn(
        "event_seq", F.lit(event_seq_base) + F.col("event_seq"))


def stale_count(runs: DataFrame, now, max_age_hours: float = STALE_MAX_AGE_HOURS) -> DataFrame:
    return runs.agg(F.count_if(stale_filter(runs, now, max_age_hours)).alias("affected"))


# W1 -------------------------------------------------------------------------
def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run per collector (by started_at, ties by run_id). A partial
    max_by aggregation: a collector with most of the log is combined map-side
    instead of landing whole in one window task."""
    payload = [c for c in runs.columns if c != "collector_name"]
    return (runs.groupBy("collector_name")
            .agg(F.max_by(F.struct(*payload), F.struct("started_at", "run_id")).alias("_r"))
            .select("collector_name", "_r.*"))


# W2 -------------------------------------------------------------------------
def latest_run(runs: DataFrame, collector: str) -> DataFrame:
    return (runs.filter(F.col("collector_name") == collector)
            .orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1))


# A5 -------------------------------------------------------------------------
def running_collectors(runs: DataFrame) -> DataFrame:
    return runs.groupBy("collector_name").agg(
        (F.count_if(F.col("status") == "running") > 0).alias("is_running"))


def is_running(runs: DataFrame, collector: str) -> DataFrame:
    return runs.filter(F.col("collector_name") == collector).agg(
        (F.count_if(F.col("status") == "running") > 0).alias("is_running"))


# R4 -------------------------------------------------------------------------
def collector_status(runs: DataFrame) -> DataFrame:
    """Latest run and running flag of every collector (one row each), folded
    in one pass over the runs."""
    payload = [c for c in runs.columns if c != "collector_name"]
    return (runs.groupBy("collector_name")
            .agg(F.max_by(F.struct(*payload), F.struct("started_at", "run_id")).alias("_r"),
                 (F.count_if(F.col("status") == "running") > 0).alias("is_running"))
            .select("collector_name", "_r.*", "is_running"))


# R5 / R6 ----------------------------------------------------------------------
def hours_since(ts, now) -> Column:
    t = ts if isinstance(ts, Column) else F.col(ts)
    return (F.unix_micros(_ts(now)) - F.unix_micros(t.try_cast("timestamp"))) / F.lit(3_600_000_000.0)


def freshness(ts, schedule, now) -> Column:
    """fresh / stale / old by schedule thresholds; unknown schedule = daily;
    missing or invalid time = old."""
    h = hours_since(ts, now)
    s = F.col(schedule) if isinstance(schedule, str) else schedule
    fresh = F.lit(FRESHNESS_HOURS["daily"][0])
    stale = F.lit(FRESHNESS_HOURS["daily"][1])
    for name, (fr, st) in FRESHNESS_HOURS.items():
        fresh = F.when(s == name, F.lit(fr)).otherwise(fresh)
        stale = F.when(s == name, F.lit(st)).otherwise(stale)
    return (F.when(h.isNull(), F.lit("old")).when(h <= fresh, F.lit("fresh"))
            .when(h <= stale, F.lit("stale")).otherwise(F.lit("old")))


def relative_time(ts, now) -> Column:
    """'Just now' (< 1 min, also future), 'n min ago', 'n hour(s) ago',
    'n day(s) ago' (< 7), else the ISO date; missing -> 'Invalid Date'."""
    t = (ts if isinstance(ts, Column) else F.col(ts)).try_cast("timestamp")
    ms = F.floor((F.unix_micros(_ts(now)) - F.unix_micros(t)) / F.lit(1000))
    mins = F.floor(ms / F.lit(60000))
    hours = F.floor(ms / F.lit(3600000))
    days = F.floor(ms / F.lit(86400000))

    def plural(n, unit):
        return F.concat(n.cast("string"), F.lit(" " + unit),
                        F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))
    return (F.when(t.isNull(), F.lit("Invalid Date"))
            .when(mins < 1, F.lit("Just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit(" min ago")))
            .when(hours < 24, plural(hours, "hour"))
            .when(days < 7, plural(days, "day"))
            .otherwise(F.date_format(t, "yyyy-MM-dd")))


# S4 -------------------------------------------------------------------------
METADATA_SCHEMA = (
    "services MAP<STRING, STRUCT<name: STRING, provider: STRING, schedule: STRING, "
    "last_updated: STRING, services: MAP<STRING, STRUCT<last_updated: STRING, count: BIGINT>>>>, "
    "last_updated STRING")


def parse_metadata(docs: DataFrame, col: str = "value") -> DataFrame:
    """Metadata documents (JSON text) -> one row per provider/service; a
    provider without services keeps one row with null service."""
    m = docs.select(F.from_json(F.col(col), METADATA_SCHEMA).alias("m"))
    p = m.select(F.explode(F.col("m.services")).alias("provider_key", "p"))
    return p.select(
        "provider_key", F.col("p.name").alias("name"), F.col("p.provider").alias("provider"),
        F.col("p.schedule").alias("schedule"), F.col("p.last_updated").alias("provider_last_updated"),
        F.explode_outer(F.col("p.services")).alias("service", "s")).select(
        "provider_key", "name", "provider", "schedule", "provider_last_updated", "service",
        F.col("s.last_updated").alias("last_updated"), F.col("s.count").alias("count"))


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Read metadata into the flat table. A file is one document, indented or
    not, or several that each start on a line of their own; ``lines`` reads
    one document per line, splittably."""
    if lines:
        return parse_metadata(spark.read.text(path))
    docs = spark.read.text(path, wholetext=True)
    return parse_metadata(docs.select(F.explode(F.split("value", r"\r?\n(?=\{)")).alias("value")))


# J3 -------------------------------------------------------------------------
def lookup_updated(meta: DataFrame, requests: DataFrame) -> DataFrame:
    """For (provider_key, service) requests: the service's own timestamp,
    else the provider's; an unknown provider gives no row."""
    prov = meta.select("provider_key", "schedule", "provider_last_updated").distinct()
    svc = meta.filter(F.col("service").isNotNull()).select(
        "provider_key", "service", F.col("last_updated").alias("service_last_updated"))
    return (requests.join(prov, "provider_key")
            .join(svc, ["provider_key", "service"], "left")
            .select("provider_key", "service", "schedule",
                    F.coalesce("service_last_updated", "provider_last_updated").alias("last_updated")))


# R7 -------------------------------------------------------------------------
def freshness_report(meta: DataFrame, now) -> DataFrame:
    """Per provider/service: last update, freshness and relative age."""
    ts = F.try_to_timestamp(F.coalesce(F.col("last_updated"), F.col("provider_last_updated")))
    return meta.select(
        "provider_key", "service", "schedule",
        freshness(ts, F.col("schedule"), now).alias("freshness"),
        relative_time(ts, now).alias("updated"))

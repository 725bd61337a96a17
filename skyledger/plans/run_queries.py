"""Registered run-log and freshness queries.

Input: ``events`` as a collector run log: collector = user, run = event,
started = ts, counters from ``value`` and ``props.k``, status from ``k``;
metadata documents (one per event type) from the same table. Fixed
``now`` = 2024-01-31 00:00 UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import runs as R
from skyledger.plans import fixtures as X

NOW = "2024-01-31 00:00:00"


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = (F.when(k % 10 == 0, F.lit("running")).when(k % 10 == 1, F.lit("failed"))
              .otherwise(F.lit("completed")))
    started = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("run_id"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("collector_name"),
        F.col("event_type").alias("service_type"), status.alias("status"),
        started.alias("started_at"),
        F.when(status != "running", F.timestamp_micros(F.unix_micros(started) + k.cast("long") * F.lit(60_000_000)))
        .alias("completed_at"),
        F.floor("value").cast("int").alias("records_found"), k.alias("records_added"),
        (k % 7).alias("records_updated"),
        F.when(status == "completed", k % 3).alias("records_removed"),
        F.when(status == "failed", F.lit("collector error")).alias("error_message"),
        F.when(F.col("event_type") == "click", F.lit("manual")).otherwise(F.lit("scheduled"))
        .alias("trigger_type"),
        F.col("event_id").alias("event_seq"))


def schedule_of(c):
    return (F.when(c == "click", F.lit("hourly")).when(c == "view", F.lit("weekly"))
            .when(c == "error", F.lit("monthly")).otherwise(F.lit("daily")))


def _iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def metadata_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata as JSON lines, one document per (provider, service) entry in
    the nesting of the metadata file (provider -> services -> service); no
    grouping gathers a provider's services into one row."""
    e = X.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    svc = e.groupBy("event_type", "user_id").agg(F.max("ts").alias("lu"), F.count(F.lit(1)).alias("n"))
    prov = e.groupBy("event_type").agg(F.max("ts").alias("plu"))
    rows = svc.join(prov, "event_type")
    name = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 100))
    services = F.create_map(F.concat(F.lit("c"), F.col("user_id").cast("string")),
                            F.struct(_iso(F.col("lu")).alias("last_updated"), F.col("n").alias("count")))
    body = F.struct(name.alias("name"), F.lit("events").alias("provider"),
                    schedule_of(F.col("event_type")).alias("schedule"),
                    _iso(F.col("plu")).alias("last_updated"), services.alias("services"))
    return rows.select(F.to_json(F.struct(F.create_map(F.col("event_type"), body).alias("services"),
                                          _iso(F.col("plu")).alias("last_updated"))).alias("value"))


def requests(spark, sf):
    e = X.table(spark, sf, "events")
    a = e.select(F.col("event_type").alias("provider_key"),
                 F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("service"))
    b = e.select(F.col("event_type").alias("provider_key"), F.lit("nosuch").alias("service"))
    c = e.select(F.concat(F.lit("x-"), F.col("event_type")).alias("provider_key"), F.lit("c1").alias("service"))
    return a.unionByName(b).unionByName(c).distinct()


def _runs(spark, sf):
    return R.current_runs(run_log(spark, sf))


def r1_open_run(spark, sf):
    log = R.open_run(run_log(spark, sf), "new-1", "c1", "dns", "manual", NOW, 10 ** 9)
    return X.finalize(R.current_runs(log).filter(F.col("collector_name") == "c1"))


def r1_refused_when_running(spark, sf):
    """Two runs of c1 in a row: the second is refused, and the first too
    when the log already holds a running run of c1."""
    log = R.open_run_if_free(run_log(spark, sf), "new-1", "c1", "dns", "manual", NOW, 10 ** 9)
    log = R.open_run_if_free(log, "new-2", "c1", "dns", "manual", NOW, 10 ** 9 + 1)
    return X.finalize(R.current_runs(log).filter(F.col("collector_name") == "c1"))


def r2_close_run(spark, sf):
    log = R.open_run(run_log(spark, sf), "new-1", "c1", "dns", "manual", NOW, 10 ** 9)
    log = R.close_run(log, "new-1", 12, 3, 9, 1, None, "2024-01-31 00:05:00", 10 ** 9 + 1)
    log = R.open_run(log, "new-2", "c2", "dns", "scheduled", NOW, 10 ** 9 + 2)
    log = R.close_run(log, "new-2", 0, 0, 0, 0, "token expired", "2024-01-31 00:01:00", 10 ** 9 + 3)
    return X.finalize(R.current_runs(log).filter(F.col("collector_name").isin("c1", "c2")))


def r5_freshness(spark, sf):
    lr = R.latest_runs(_runs(spark, sf))
    return lr.select("collector_name", "service_type",
                     R.freshness(F.col("started_at"), schedule_of(F.col("service_type")), NOW).alias("freshness"))


def r6_relative_time(spark, sf):
    lr = R.latest_runs(_runs(spark, sf))
    return lr.select("collector_name", R.relative_time(F.col("started_at"), NOW).alias("updated"))


QUERIES = {
    "r1_open_run": r1_open_run,
    "r1_refused_when_running": r1_refused_when_running,
    "r2_close_run": r2_close_run,
    "r3_repair_stale": lambda s, sf: X.finalize(R.repair_stale(_runs(s, sf), NOW)),
    "r3_stale_count": lambda s, sf: R.stale_count(_runs(s, sf), NOW),
    "r4_collector_status": lambda s, sf: X.finalize(R.collector_status(_runs(s, sf))),
    "w1_latest_runs": lambda s, sf: X.finalize(R.latest_runs(_runs(s, sf))),
    "w2_latest_run": lambda s, sf: X.finalize(R.latest_run(_runs(s, sf), "c7")),
    "a5_running_collectors": lambda s, sf: R.running_collectors(_runs(s, sf)),
    "a5_is_running": lambda s, sf: R.is_running(_runs(s, sf), "c7"),
    "r5_freshness": r5_freshness,
    "r6_relative_time": r6_relative_time,
    "s4_read_metadata": lambda s, sf: R.parse_metadata(metadata_docs(s, sf)),
    "j3_lookup_updated": lambda s, sf: R.lookup_updated(R.parse_metadata(metadata_docs(s, sf)),
                                                        requests(s, sf)),
    "r7_freshness_report": lambda s, sf: R.freshness_report(R.parse_metadata(metadata_docs(s, sf)), NOW),
}

# --- SQL twins ---------------------------------------------------------------
LOG = """log AS (
 SELECT CAST(event_id AS VARCHAR) AS run_id, 'c' || CAST(user_id AS VARCHAR) AS collector_name,
   event_type AS service_type,
   CASE WHEN k % 10 = 0 THEN 'running' WHEN k % 10 = 1 THEN 'failed' ELSE 'completed' END AS status,
   ts AS started_at,
   CASE WHEN k % 10 <> 0 THEN ts + to_minutes(k) END AS completed_at,
   CAST(floor(value) AS INTEGER) AS records_found, k AS records_added, k % 7 AS records_updated,
   CASE WHEN k % 10 NOT IN (0, 1) THEN k % 3 END AS records_removed,
   CASE WHEN k % 10 = 1 THEN 'collector error' END AS error_message,
   CASE WHEN event_type = 'click' THEN 'manual' ELSE 'scheduled' END AS trigger_type,
   event_id AS event_seq
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))"""

_T = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
RUN_OUT = ("run_id, collector_name, service_type, status, " + _T.format("started_at") + ", "
           + _T.format("completed_at") + ", records_found, records_added, records_updated, records_removed, "
           "error_message, trigger_type, event_seq")
LATEST = LOG + """, lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY collector_name
  ORDER BY started_at DESC, run_id DESC) AS rn FROM log) WHERE rn = 1)"""
SCHED = ("CASE {0} WHEN 'click' THEN 'hourly' WHEN 'view' THEN 'weekly' WHEN 'error' THEN 'monthly' "
         "ELSE 'daily' END")
NOW_US = "epoch_us(TIMESTAMP '2024-01-31 00:00:00')"


def _fresh(ts: str, sched: str) -> str:
    h = f"(({NOW_US} - epoch_us({ts})) / 3600000000.0)"
    fr = f"CASE {sched} WHEN 'hourly' THEN 2 WHEN 'weekly' THEN 168 ELSE 26 END"
    st = f"CASE {sched} WHEN 'hourly' THEN 4 WHEN 'weekly' THEN 336 ELSE 50 END"
    return (f"CASE WHEN {ts} IS NULL THEN 'old' WHEN {h} <= {fr} THEN 'fresh' "
            f"WHEN {h} <= {st} THEN 'stale' ELSE 'old' END")


def _rel(ts: str) -> str:
    ms = f"(({NOW_US} - epoch_us({ts})) // 1000)"
    mins, hours, days = f"({ms} // 60000)", f"({ms} // 3600000)", f"({ms} // 86400000)"
    return (f"CASE WHEN {ts} IS NULL THEN 'Invalid Date' WHEN {mins} < 1 THEN 'Just now' "
            f"WHEN {mins} < 60 THEN CAST({mins} AS VARCHAR) || ' min ago' "
            f"WHEN {hours} < 24 THEN CAST({hours} AS VARCHAR) || ' hour' || CASE WHEN {hours} > 1 THEN 's' ELSE '' END || ' ago' "
            f"WHEN {days} < 7 THEN CAST({days} AS VARCHAR) || ' day' || CASE WHEN {days} > 1 THEN 's' ELSE '' END || ' ago' "
            f"ELSE strftime({ts}, '%Y-%m-%d') END")


META = """svc AS (SELECT event_type, user_id, date_trunc('second', max(ts)) AS lu, count(*) AS n
  FROM events GROUP BY 1, 2),
meta AS (SELECT s.event_type AS provider_key,
   upper(substr(s.event_type, 1, 1)) || substr(s.event_type, 2) AS name, 'events' AS provider,
   """ + SCHED.format("s.event_type") + """ AS schedule,
   strftime(p.plu, '%Y-%m-%dT%H:%M:%SZ') AS provider_last_updated, p.plu,
   'c' || CAST(s.user_id AS VARCHAR) AS service, strftime(s.lu, '%Y-%m-%dT%H:%M:%SZ') AS last_updated,
   s.lu, s.n AS count
 FROM svc s JOIN (SELECT event_type, max(lu) AS plu FROM svc GROUP BY 1) p ON s.event_type = p.event_type)"""

SQL = {
    "r1_open_run": "WITH " + LOG + f""", allr AS (SELECT * FROM log UNION ALL
  SELECT 'new-1', 'c1', 'dns', 'running', TIMESTAMP '2024-01-31 00:00:00', NULL, NULL, NULL, NULL, NULL,
         NULL, 'manual', 1000000000)
SELECT {RUN_OUT} FROM allr WHERE collector_name = 'c1'""",
    "r1_refused_when_running": "WITH " + LOG + f""", allr AS (SELECT * FROM log UNION ALL
  SELECT 'new-1', 'c1', 'dns', 'running', TIMESTAMP '2024-01-31 00:00:00', NULL, NULL, NULL, NULL, NULL,
         NULL, 'manual', 1000000000
  WHERE NOT EXISTS (SELECT 1 FROM log WHERE collector_name = 'c1' AND status = 'running'))
SELECT {RUN_OUT} FROM allr WHERE collector_name = 'c1'""",
    "r2_close_run": "WITH " + LOG + f""", allr AS (SELECT * FROM log WHERE collector_name IN ('c1', 'c2') UNION ALL
  SELECT 'new-1', 'c1', 'dns', 'completed', TIMESTAMP '2024-01-31 00:00:00', TIMESTAMP '2024-01-31 00:05:00',
         12, 3, 9, 1, NULL, 'manual', 1000000001
  UNION ALL
  SELECT 'new-2', 'c2', 'dns', 'failed', TIMESTAMP '2024-01-31 00:00:00', TIMESTAMP '2024-01-31 00:01:00',
         0, 0, 0, 0, 'token expired', 'scheduled', 1000000003)
SELECT {RUN_OUT} FROM allr""",
    "r3_repair_stale": "WITH " + LOG + """, st AS (SELECT *, status = 'running' AND
  started_at < TIMESTAMP '2024-01-30 22:00:00' AS stale FROM log)
SELECT run_id, collector_name, service_type, CASE WHEN stale THEN 'failed' ELSE status END AS status,
  strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(CASE WHEN stale THEN TIMESTAMP '2024-01-31 00:00:00' ELSE completed_at END, '%Y-%m-%d %H:%M:%S')
    AS completed_at, records_found, records_added, records_updated, records_removed,
  CASE WHEN stale THEN 'Process terminated unexpectedly' ELSE error_message END AS error_message,
  trigger_type, event_seq FROM st""",
    "r3_stale_count": "WITH " + LOG + """ SELECT CAST(count(*) FILTER (WHERE status = 'running' AND
  started_at < TIMESTAMP '2024-01-30 22:00:00') AS BIGINT) AS affected FROM log""",
    "r4_collector_status": "WITH " + LATEST + f""", rc AS (SELECT collector_name,
  count(*) FILTER (WHERE status = 'running') > 0 AS is_running FROM log GROUP BY 1)
SELECT {RUN_OUT}, is_running FROM lr JOIN rc USING (collector_name)""",
    "w1_latest_runs": "WITH " + LATEST + f" SELECT {RUN_OUT} FROM lr",
    "w2_latest_run": "WITH " + LOG + f""" SELECT {RUN_OUT} FROM log WHERE collector_name = 'c7'
  ORDER BY started_at DESC, run_id DESC LIMIT 1""",
    "a5_running_collectors": "WITH " + LOG + """ SELECT collector_name,
  count(*) FILTER (WHERE status = 'running') > 0 AS is_running FROM log GROUP BY 1""",
    "a5_is_running": "WITH " + LOG + """ SELECT count(*) FILTER (WHERE status = 'running') > 0 AS is_running
  FROM log WHERE collector_name = 'c7'""",
    "r5_freshness": "WITH " + LATEST + f""" SELECT collector_name, service_type,
  {_fresh('started_at', SCHED.format('service_type'))} AS freshness FROM lr""",
    "r6_relative_time": "WITH " + LATEST + f" SELECT collector_name, {_rel('started_at')} AS updated FROM lr",
    "s4_read_metadata": "WITH " + META + """ SELECT provider_key, name, provider, schedule,
  provider_last_updated, service, last_updated, CAST(count AS BIGINT) AS count FROM meta""",
    "j3_lookup_updated": "WITH " + META + """, req AS (
  SELECT DISTINCT event_type AS provider_key, 'c' || CAST(user_id AS VARCHAR) AS service FROM events
  UNION SELECT DISTINCT event_type, 'nosuch' FROM events
  UNION SELECT DISTINCT 'x-' || event_type, 'c1' FROM events),
prov AS (SELECT DISTINCT provider_key, schedule, provider_last_updated FROM meta)
SELECT r.provider_key, r.service, p.schedule, coalesce(m.last_updated, p.provider_last_updated) AS last_updated
FROM req r JOIN prov p ON r.provider_key = p.provider_key
LEFT JOIN meta m ON r.provider_key = m.provider_key AND r.service = m.service""",
    "r7_freshness_report": "WITH " + META + f""" SELECT provider_key, service, schedule,
  {_fresh('lu', 'schedule')} AS freshness, {_rel('lu')} AS updated FROM meta""",
}

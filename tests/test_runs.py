"""Run log folding, stale repair, latest run, freshness and relative time."""

from pyspark.sql import functions as F

from skyledger.operators import runs as R

NOW = "2024-01-31 00:00:00"


def test_open_close_fold(spark):
    log = R.empty_log(spark)
    log = R.open_run(log, "r1", "godaddy", "dns", "manual", "2024-01-30 10:00:00", 1)
    log = R.open_run(log, "r2", "godaddy", "dns", "scheduled", "2024-01-30 23:00:00", 2)
    log = R.close_run(log, "r1", 10, 2, 8, 1, None, "2024-01-30 10:05:00", 3)
    runs = {r["run_id"]: r for r in R.current_runs(log).collect()}
    assert runs["r1"]["status"] == "completed" and runs["r1"]["records_found"] == 10
    assert runs["r2"]["status"] == "running"
    latest = R.latest_runs(R.current_runs(log)).first()
    assert latest["run_id"] == "r2"
    assert R.is_running(R.current_runs(log), "godaddy").first()[0] is True
    fixed = {r["run_id"]: r for r in R.repair_stale(R.current_runs(log), "2024-01-31 02:00:00").collect()}
    assert fixed["r2"]["status"] == "failed"
    assert fixed["r2"]["error_message"] == "Process terminated unexpectedly"
    assert R.stale_count(R.current_runs(log), "2024-01-31 00:30:00").first()[0] == 0


def test_freshness_and_relative_time(spark):
    rows = [("2024-01-30 23:59:30", "hourly"), ("2024-01-30 23:10:00", "daily"), ("2024-01-30 21:00:00", "hourly"),
            ("2024-01-29 00:00:00", "daily"), ("2024-01-20 00:00:00", "weekly"), ("2024-01-10 00:00:00", "weekly"),
            (None, "daily"), ("2024-01-31 05:00:00", "monthly"), ("2023-12-01 00:00:00", "odd")]
    df = spark.createDataFrame(rows, "t string, s string").withColumn("ts", F.col("t").cast("timestamp"))
    got = [tuple(r) for r in df.select(R.freshness(F.col("ts"), F.col("s"), NOW),
                                       R.relative_time(F.col("ts"), NOW)).collect()]
    assert got == [("fresh", "Just now"), ("fresh", "50 min ago"), ("stale", "3 hours ago"),
                   ("stale", "2 days ago"), ("stale", "2024-01-20"), ("old", "2024-01-10"),
                   ("old", "Invalid Date"), ("fresh", "Just now"), ("old", "2023-12-01")]


def test_invalid_text_times_are_old(spark):
    df = spark.createDataFrame([("not a date", "daily"), ("2024-01-30T23:30:00Z", "hourly")], "t string, s string")
    got = [tuple(r) for r in df.select(R.freshness(F.col("t"), F.col("s"), NOW),
                                       R.relative_time(F.col("t"), NOW)).collect()]
    assert got == [("old", "Invalid Date"), ("fresh", "30 min ago")]

"""Stores across sessions, number text and run states."""

import tempfile

from pyspark.sql import functions as F

from skyledger.functions.expr import _js_sql
from skyledger.operators import runs as R
from skyledger.sources.readers import BucketedSnapshot


def test_bucketed_snapshot_of_another_session_is_kept_and_read(spark):
    base = tempfile.mkdtemp() + "/snap"
    one = spark.createDataFrame([("a.io", "x", 1)], "domain string, source string, n int")
    assert BucketedSnapshot(spark, base, "snap_two", ["domain"], 2, "source").commit(one) == 0
    other = spark.newSession()
    for t in other.catalog.listTables():  # as in a session whose catalog has never seen the table
        if t.name.startswith("snap_two"):
            other.sql(f"DROP TABLE {t.name}")
    store = BucketedSnapshot(other, base, "snap_two", ["domain"], 2, "source")
    assert [tuple(r) for r in store.read().select("domain", "source", "n").collect()] == [("a.io", "x", 1)]
    assert store.commit(other.createDataFrame([("b.io", "x", 2)], "domain string, source string, n int")) == 1
    assert [r.domain for r in store.read().collect()] == ["b.io"]
    assert spark.read.parquet(f"{base}/v=0").count() == 1


def test_number_text_is_plain_like_javascript(spark):
    values = [12345678.9, 0.0001, 0.000001234, 1.5, -0.25, 1e21, 1.5e22, 1e-7, 1.5e-7, 100.0, 9007199254740993.5]
    want = ["12345678.9", "0.0001", "0.000001234", "1.5", "-0.25", "1e+21", "1.5e+22", "1e-7", "1.5e-7", "100", "9007199254740994"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(F.expr(_js_sql("v", df.schema["v"].dataType))).collect()] == want


def test_an_empty_error_message_is_a_failure(spark):
    log = R.open_run(R.empty_log(spark), "r1", "godaddy", "dns", "manual", "2024-01-30 10:00:00", 1)
    log = R.close_run(log, "r1", 0, 0, 0, 0, "", "2024-01-30 10:05:00", 2)
    assert R.current_runs(log).first()["status"] == "failed"

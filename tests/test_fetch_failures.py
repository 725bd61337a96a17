"""A failed page never marks live assets removed."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from skyledger import collection as C
from skyledger.operators import normalize as N


def _stores(spark):
    import skyledger.cli as cli

    return cli._stores(spark, tempfile.mkdtemp())


def _frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).withColumn("_doc", F.struct(F.lit("f").alias("file"), F.monotonically_increasing_id().alias("line")))


def _pages(spark, zones, records):
    ok = lambda result: json.dumps({"success": True, "result": result})
    bad = json.dumps({"success": False, "errors": [{"code": 1, "message": "rate limited"}]})
    z = _frame(spark, [(ok(x) if x is not None else bad,) for x in zones], "value string")
    r = _frame(spark, [(None, k, ok(x) if x is not None else bad) for k, x in records], "domain string, zone_id string, value string")
    return z, r


def _record(name, zone):
    return {"type": "A", "name": name, "content": "10.0.0.1", "ttl": 60}


def _day(spark, stores, zones, records, day):
    z, r = _pages(spark, zones, records)
    return C.run_collection(spark, stores, N.CLOUDFLARE, z, r, day, f"{day} 00:00:00", f"run-{day}", 2 * int(day[-2:])).first()


def test_failed_pages_leave_assets_alone(spark):
    stores = _stores(spark)
    a, b = {"id": "z1", "name": "a.io"}, {"id": "z2", "name": "b.io"}
    ra, rb = [("z1", [_record("www.a.io", "z1")]), ("z2", [_record("www.b.io", "z2")])]
    assert _day(spark, stores, [[a], [b]], [ra, rb], "2024-05-01")["status"] == "completed"
    with pytest.raises(ValueError, match="rate limited"):
        _day(spark, stores, [[a], None], [ra, rb], "2024-05-02")
    log = {r["run_id"]: r for r in C.R.current_runs(C.read_run_log(spark, stores.run_log_dir)).collect()}
    assert log["run-2024-05-02"]["status"] == "failed" and "rate limited" in log["run-2024-05-02"]["error_message"]
    assert {r["domain"]: r["status"] for r in stores.domains.read().collect()} == {"a.io": "active", "b.io": "active"}
    _day(spark, stores, [[a], [b]], [("z1", None), ("z1", []), rb], "2024-05-03")
    assert {r["domain"]: r["status"] for r in stores.records.read().collect()} == {"a.io": "active", "b.io": "active"}


def test_unreadable_page_is_rejected(spark):
    docs = _frame(spark, [('[{"domain": "a.io"}]',), ('{"code": "ERROR"}',), ('[{"domain": ',), ("[]",)], "value string")
    assert N.rejected_pages(docs, N.GODADDY).count() == 2

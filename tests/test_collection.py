"""One collection run end to end, twice, plus a failing run."""

import json
import tempfile

import pytest

from skyledger.collection import CollectionStores, read_run_log, run_collection
from skyledger.operators import runs as R
from skyledger.schemas import DNS_DDL, DOMAINS_DDL
from skyledger.sources import readers as S


def _docs(spark, pages, domain=None):
    rows = [((domain,) if domain else ()) + (i, json.dumps(p)) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, ("domain string, " if domain else "") + "_doc long, value string")


def test_two_runs_and_failure(spark):
    base = tempfile.mkdtemp(prefix="skyledger-coll-")
    stores = CollectionStores(S.SnapshotStore(spark, f"{base}/d", "registrar", DOMAINS_DDL),
                              S.SnapshotStore(spark, f"{base}/r", "source", DNS_DDL), f"{base}/runs")
    d1 = _docs(spark, [[{"domain": "a.io"}, {"domain": "b.io"}]])
    r1 = _docs(spark, [[{"name": "@", "type": "A", "data": "1"}, {"name": "www", "type": "A", "data": "2"}]], "a.io")
    run1 = run_collection(spark, stores, "GoDaddy", d1, r1, "2024-03-01", "2024-03-01 06:00:00", "r1", 1).first()
    assert (run1["status"], run1["records_found"], run1["records_added"]) == ("completed", 4, 4)

    d2 = _docs(spark, [[{"domain": "a.io"}]])
    r2 = _docs(spark, [[{"name": "@", "type": "A", "data": "1"}]], "a.io")
    run2 = run_collection(spark, stores, "GoDaddy", d2, r2, "2024-03-02", "2024-03-02 06:00:00", "r2", 3).first()
    assert (run2["records_added"], run2["records_updated"], run2["records_removed"]) == (0, 2, 2)
    dom = {r["domain"]: r["status"] for r in stores.domains.read().collect()}
    assert dom == {"a.io": "active", "b.io": "removed"}

    # record pages landed without their domain: the run fails and is logged as failed
    bad = _docs(spark, [[{"name": "@", "type": "A", "data": "1"}]])
    with pytest.raises(Exception):
        run_collection(spark, stores, "GoDaddy", d2, bad, "2024-03-03", "2024-03-03 06:00:00", "r3", 5)
    state = {r["run_id"]: r for r in R.current_runs(read_run_log(spark, stores.run_log_dir)).collect()}
    assert state["r3"]["status"] == "failed" and "domain" in state["r3"]["error_message"]
    assert R.latest_runs(R.current_runs(read_run_log(spark, stores.run_log_dir))).first()["run_id"] == "r3"


def test_cloudflare_collection(spark):
    base = tempfile.mkdtemp(prefix="skyledger-cf-")
    stores = CollectionStores(S.SnapshotStore(spark, f"{base}/d", "registrar", DOMAINS_DDL, "status"),
                              S.SnapshotStore(spark, f"{base}/r", "source", DNS_DDL, "status"), f"{base}/runs")
    zones = _docs(spark, [{"success": True, "result": [{"id": "z1", "name": "a.io"}, {"id": "z2", "name": "test.com"}]}])
    recs = spark.createDataFrame([("z1", 0, json.dumps({"success": True, "result": [
        {"name": "a.io", "type": "A", "content": "1"}, {"name": "www.a.io", "type": "CNAME", "content": "a.io"}]})),
        ("z2", 1, json.dumps({"success": True, "result": [{"name": "test.com", "type": "A", "content": "2"}]}))],
        "zone_id string, _doc long, value string")
    run = run_collection(spark, stores, "Cloudflare", zones, recs, "2024-03-01", "2024-03-01 06:00:00", "c1", 1).first()
    assert (run["records_found"], run["records_added"]) == (3, 3)
    assert sorted(r["subdomain"] for r in stores.records.read().collect()) == ["", "www"]


def test_compact_run_log(spark, tmp_path):
    from skyledger.collection import compact_run_log
    log = R.open_run(R.empty_log(spark), "r1", "c", "dns", "manual", "2024-01-01 00:00:00", 1)
    log = R.close_run(log, "r1", 1, 1, 0, 0, None, "2024-01-01 00:10:00", 2)
    log.write.parquet(str(tmp_path / "log"))
    compact_run_log(spark, str(tmp_path / "log"), str(tmp_path / "compact"))
    rows = spark.read.parquet(str(tmp_path / "compact")).collect()
    assert len(rows) == 1 and rows[0]["status"] == "completed"

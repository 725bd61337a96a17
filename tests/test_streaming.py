"""Incremental mode: file drops on two days, removal on the later day, and a
replayed batch rewriting its own snapshot version."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from skyledger.collection import CollectionStores
from skyledger.schemas import DNS_DDL, DOMAINS_DDL
from skyledger.sources import readers as S
from skyledger.streaming.incremental import IncrementalSync


def _drop(path, pages, records=()):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w") as f:
        for p in pages:
            f.write(json.dumps({"kind": "domains", "body": p}) + "\n")
        for domain, p in records:
            f.write(json.dumps({"kind": "records", "domain": domain, "body": p}) + "\n")


def test_two_days_and_replay(spark):
    base = tempfile.mkdtemp(prefix="skyledger-stream-")
    day = {"v": "2024-03-01"}
    stores = CollectionStores(S.SnapshotStore(spark, f"{base}/d", "registrar", DOMAINS_DDL),
                              S.SnapshotStore(spark, f"{base}/r", "source", DNS_DDL), f"{base}/runs")
    job = IncrementalSync(f"{base}/landed", stores, f"{base}/ckpt", as_of=lambda: day["v"])
    _drop(f"{base}/landed/d1", [[{"domain": "a.io", "expires": "2026-01-01T00:00:00Z"}, {"domain": "b.io"}],
                                [{"domain": "example.com"}, {"domain": "c.io"}]],
          [("a.io", [{"name": "@", "type": "A", "data": "1"}, {"name": "old", "type": "A", "data": "2"}])])
    job.start(spark).awaitTermination()
    snap = {r["domain"]: r["status"] for r in job.domains().collect()}
    assert snap == {"a.io": "active", "b.io": "active", "c.io": "active"}
    assert job.records().count() == 2

    day["v"] = "2024-03-02"
    _drop(f"{base}/landed/d2", [[{"domain": "a.io"}, {"domain": "d.io"}]],
          [("a.io", [{"name": "@", "type": "A", "data": "1"}])])
    job.start(spark).awaitTermination()
    snap = {r["domain"]: (r["status"], str(r["last_seen"])) for r in job.domains().collect()}
    assert snap["a.io"] == ("active", "2024-03-02")
    assert snap["b.io"] == ("removed", "2024-03-01")       # not in the second full fetch
    assert snap["d.io"][0] == "active"
    recs = {r["subdomain"]: r["status"] for r in job.records().collect()}
    assert recs == {"": "active", "old": "removed"}
    runs = {r["run_id"]: r for r in job.run_log(spark).collect()}
    assert len(runs) == 2
    assert sorted((r["records_added"], r["records_removed"]) for r in runs.values()) == [(1, 3), (5, 0)]

    # replay the second batch: it keeps its version
    part = f"{base}/d/registrar=GoDaddy"
    before = S.latest_version(spark, part)
    docs = spark.read.text(f"{base}/landed/d2").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    job._batch(docs, 1)
    assert S.latest_version(spark, part) == before
    again = {r["domain"]: (r["status"], str(r["last_seen"])) for r in job.domains().collect()}
    assert again == snap

    # a reset checkpoint starts again at batch 0: its run takes the next free version
    day["v"] = "2024-03-03"
    fresh = IncrementalSync(f"{base}/landed2", stores, f"{base}/ckpt2", as_of=lambda: day["v"])
    _drop(f"{base}/landed2/d3", [[{"domain": "a.io"}, {"domain": "e.io"}]])
    fresh.start(spark).awaitTermination()
    assert S.latest_version(spark, part) == before + 1
    now = {r["domain"]: r["status"] for r in job.domains().collect()}
    assert now["e.io"] == "active" and now["d.io"] == "removed"


def test_pages_wait_for_the_end_of_their_fetch(spark):
    base = tempfile.mkdtemp(prefix="skyledger-fetch-")
    stores = CollectionStores(S.SnapshotStore(spark, f"{base}/d", "registrar", DOMAINS_DDL),
                              S.SnapshotStore(spark, f"{base}/r", "source", DNS_DDL), f"{base}/runs")
    job = IncrementalSync(f"{base}/landed", stores, f"{base}/ckpt", as_of=lambda: "2024-03-01",
                          pending=f"{base}/pending")
    os.makedirs(f"{base}/landed")
    for i, lines in enumerate([[{"kind": "domains", "fetch": "f1", "body": [{"domain": "a.io"}]}],
                               [{"kind": "domains", "fetch": "f1", "body": [{"domain": "b.io"}]},
                                {"kind": "end", "fetch": "f1"},
                                {"kind": "domains", "fetch": "f2", "body": [{"domain": "z.io"}]}]]):
        with open(f"{base}/landed/{i}.txt", "w") as f:
            f.writelines(json.dumps(x) + "\n" for x in lines)
        job.start(spark).awaitTermination()
        seen = {r["domain"] for r in job.domains().collect()}
        assert seen == (set() if i == 0 else {"a.io", "b.io"})


def _land(base, name, lines, landed):
    """A file of envelope lines, landed at ``landed`` (minutes)."""
    os.makedirs(f"{base}/landed", exist_ok=True)
    path = f"{base}/landed/{name}.txt"
    with open(path, "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in lines)
    os.utime(path, (1_700_000_000 + 60 * landed,) * 2)


def test_fetches_out_of_order_replayed_and_lost(spark):
    base = tempfile.mkdtemp(prefix="skyledger-state-")
    stores = CollectionStores(S.SnapshotStore(spark, f"{base}/d", "registrar", DOMAINS_DDL),
                              S.SnapshotStore(spark, f"{base}/r", "source", DNS_DDL), f"{base}/runs")
    job = IncrementalSync(f"{base}/landed", stores, f"{base}/ckpt", as_of=lambda: "2024-03-01", pending=f"{base}/pending",
                          fetch_timeout_ms=60 * 60_000)
    page = lambda fetch, n, *names: {"kind": "domains", "fetch": fetch, "page": n, "body": [{"domain": d} for d in names]}
    # the end comes first, one page is landed twice, one fetch never ends
    _land(base, "0", [{"kind": "end", "fetch": "f1", "pages": 2}, page("f1", 2, "b.io"), page("lost", 1, "l.io")], 0)
    _land(base, "1", [page("f1", 2, "b.io")], 1)
    job.start(spark).awaitTermination()
    assert job.domains().count() == 0
    _land(base, "2", [page("f1", 1, "a.io")], 30)
    job.start(spark).awaitTermination()
    assert {r["domain"] for r in job.domains().collect()} == {"a.io", "b.io"}
    _land(base, "3", [page("f2", 1, "a.io", "c.io"), {"kind": "end", "fetch": "f2"}], 120)
    job.start(spark).awaitTermination()
    assert {r["domain"]: r["status"] for r in job.domains().collect()} == {"a.io": "active", "b.io": "active", "c.io": "active"}
    runs = {r["run_id"].split("-fetch-")[1]: r for r in job.run_log(spark).collect()}
    assert {k: r["status"] for k, r in runs.items()} == {"f1": "completed", "f2": "completed", "lost": "failed"}
    assert "never ended: 1 pages" in runs["lost"]["error_message"]
    listed = spark.read.parquet(f"{base}/pending/expired/*").first()
    assert listed["fetch"] == "lost" and [os.path.basename(f) for f in listed["files"]] == ["0.txt"]
    # nothing is kept of fetches that are over
    state = spark.read.format("statestore").option("stateVarName", "about").load(f"{base}/ckpt")
    assert state.count() == 0

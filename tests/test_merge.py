"""Merge semantics and properties on small hand-written frames."""

import random

from pyspark.sql import functions as F

from skyledger.operators import merge as M
from skyledger.schemas import DNS_DDL, DOMAINS_DDL

D0 = "2024-01-10"


def _snap(spark, rows):
    return spark.createDataFrame(rows, DOMAINS_DDL)


def _row(domain, reg, status, disc, last, expiry=None, raw=None):
    import datetime as dt
    d = dt.date.fromisoformat
    return (domain, reg, status, d(expiry) if expiry else None, d(disc), d(last), raw, None, None)


def _batch(spark, rows):
    return spark.createDataFrame(rows, "domain string, expiry_date date, raw_data string, _ordinal long")


def _as_dict(df, keys=("domain", "registrar")):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def test_merge_domains_cases(spark):
    import datetime as dt
    s = _snap(spark, [_row("a.io", "GD", "active", "2024-01-01", "2024-01-09", "2025-01-01"),
                      _row("b.io", "GD", "removed", "2023-05-01", "2023-06-01"),
                      _row("c.io", "GD", "active", "2024-01-02", "2024-01-09"),
                      _row("c.io", "CF", "active", "2024-01-02", "2024-01-02"),
                      _row("d.io", "GD", "active", "2024-01-02", D0)])
    b = _batch(spark, [("a.io", None, "r1", 1), ("b.io", dt.date(2026, 1, 1), "r2", 2),
                       ("e.io", None, "r3", 3), ("e.io", None, "r4", 4)])
    m = M.merge_domains(s, b, "GD", D0, f"{D0} 00:00:00")
    out = _as_dict(m.snapshot)
    assert out[("a.io", "GD")]["status"] == "active" and out[("a.io", "GD")]["expiry_date"] is None  # D9
    assert out[("a.io", "GD")]["discovery_date"] == dt.date(2024, 1, 1)
    assert out[("b.io", "GD")]["status"] == "active"            # reactivated, discovery kept
    assert out[("b.io", "GD")]["discovery_date"] == dt.date(2023, 5, 1)
    assert out[("c.io", "GD")]["status"] == "removed"           # stale, last_seen stays
    assert out[("c.io", "GD")]["last_seen"] == dt.date(2024, 1, 9)
    assert out[("c.io", "CF")]["status"] == "active"            # other source untouched
    assert out[("d.io", "GD")]["status"] == "active"            # seen today already (D6)
    assert out[("e.io", "GD")]["raw_data"] == "r4"              # last in batch wins (M5)
    st = m.stats.first().asDict()
    assert st == {"added": 1, "updated": 3, "removed": 1, "reactivated": 1}
    changes = {r["domain"]: r["change"] for r in m.changes.collect()}
    assert changes == {"a.io": "updated", "b.io": "reactivated", "c.io": "removed", "d.io": "unchanged",
                       "e.io": "added"}


def test_merge_keys_mode_removes_same_day(spark):
    s = _snap(spark, [_row("d.io", "GD", "active", "2024-01-02", D0)])
    b = _batch(spark, [("a.io", None, "r", 1)])
    out = _as_dict(M.merge_domains(s, b, "GD", D0, mode="keys").snapshot)
    assert out[("d.io", "GD")]["status"] == "removed"


def test_merge_properties_random(spark):
    rnd = random.Random(7)
    names = [f"n{i}.io" for i in range(40)]
    snap = []
    for n in rnd.sample(names, 25):
        last = f"2024-01-{rnd.randint(1, 9):02d}"
        snap.append(_row(n, rnd.choice(["GD", "CF"]), rnd.choice(["active", "removed"]), "2023-12-01", last))
    seen = set()
    snap = [r for r in snap if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))]
    batch = [(rnd.choice(names), None, f"r{i}", i) for i in range(30)]
    s, b = _snap(spark, snap), _batch(spark, batch)
    m = M.merge_domains(s, b, "GD", D0, f"{D0} 00:00:00")
    out = m.snapshot
    # keys unique
    assert out.count() == out.select("domain", "registrar").distinct().count()
    st = m.stats.first()
    assert st["added"] + st["updated"] == len(batch)
    bkeys = {x[0] for x in batch}
    removed = {r["domain"] for r in m.changes.filter(F.col("change") == "removed").collect()}
    assert not (removed & bkeys)
    old = {(r[0], r[1]): r for r in snap}
    for r in out.collect():
        k = (r["domain"], r["registrar"])
        if k in old:
            assert r["discovery_date"] == old[k][4]           # discovery never changes
            if k[1] == "CF":
                assert r["status"] == old[k][2]               # other source unchanged
    # idempotent on the same day
    again = M.merge_domains(out, b, "GD", D0, f"{D0} 00:00:00").snapshot
    cols = ["domain", "registrar", "status", "discovery_date", "last_seen", "raw_data"]
    assert sorted(map(tuple, again.select(cols).collect())) == sorted(map(tuple, out.select(cols).collect()))


def test_dns_removal_scope_and_checked_domains(spark):
    import datetime as dt
    d = dt.date.fromisoformat
    rows = [("a.io", "www", "A", "1", 300, 0, "GD", "active", d("2024-01-01"), d("2024-01-05"), None, None, None),
            ("a.io", "old", "A", "2", 300, 0, "GD", "active", d("2024-01-01"), d("2024-01-05"), None, None, None),
            ("b.io", "", "MX", "m", 300, 10, "GD", "active", d("2024-01-01"), d("2024-01-05"), None, None, None)]
    s = spark.createDataFrame(rows, DNS_DDL)
    b = spark.createDataFrame([("a.io", "www", "A", "1", 60, 0, None, 1)],
                              "domain string, subdomain string, record_type string, data string, ttl int, "
                              "priority int, raw_data string, _ordinal long")
    m = M.merge_dns_records(s, b, "GD", D0)
    st = {(r["domain"], r["subdomain"]): r["status"] for r in m.snapshot.collect()}
    assert st == {("a.io", "www"): "active", ("a.io", "old"): "removed", ("b.io", ""): "active"}  # D7
    checked = spark.createDataFrame([("b.io",)], "domain string")
    m2 = M.merge_dns_records(s, b, "GD", D0, checked_domains=checked)
    st2 = {(r["domain"], r["subdomain"]): r["status"] for r in m2.snapshot.collect()}
    assert st2[("b.io", "")] == "removed"


def test_run_sync_empty_batch_removes_nothing(spark):
    s = _snap(spark, [_row("a.io", "GD", "active", "2024-01-01", "2024-01-05")])
    empty = _batch(spark, [])
    recs = spark.createDataFrame([], "domain string, subdomain string, record_type string, data string, "
                                     "ttl int, priority int, raw_data string, _ordinal long")
    res = M.run_sync(s, spark.createDataFrame([], DNS_DDL), empty, recs, "GD", D0)
    assert res.domains.first()["status"] == "active"
    assert res.stats.first().asDict() == {"records_found": 0, "added": 0, "updated": 0, "removed": 0,
                                          "reactivated": 0}

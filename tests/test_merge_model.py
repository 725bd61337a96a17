"""The Spark merge against a brute-force model of the row-at-a-time
algorithm it replaces: for each batch row look the key up, insert or update;
then sweep the source's active rows last seen before today (DNS: only in
domains present in the batch). Random snapshots and batches, several seeds."""

import datetime as dt
import random

from skyledger.operators import merge as M
from skyledger.schemas import DNS_DDL, DOMAINS_DDL

TODAY = dt.date(2024, 3, 10)


def _model(snapshot, batch, source, keyf, payload, dns):
    rows = {keyf(r): dict(r) for r in snapshot}
    added = updated = removed = 0
    seen_domains = set()
    for b in batch:                                   # in batch order
        k = keyf({**b, "src": source})
        seen_domains.add(b["domain"])
        if k in rows:
            r = rows[k]
            r.update(status="active", last_seen=TODAY, **{p: b[p] for p in payload})
            updated += 1
        else:
            rows[k] = {**{p: b[p] for p in payload}, "domain": b["domain"], "src": source, "status": "active",
                       "discovery_date": TODAY, "last_seen": TODAY, **{x: b[x] for x in b if x in ("sub",)}}
            added += 1
    for k, r in rows.items():
        if (r["src"] == source and r["status"] == "active" and r["last_seen"] < TODAY
                and (not dns or r["domain"] in seen_domains)):
            r["status"] = "removed"
            removed += 1
    return rows, (added, updated, removed)


def _rand_day(rnd):
    return TODAY - dt.timedelta(days=rnd.choice([0, 1, 3, 30]))


def test_domains_merge_matches_model(spark):
    for seed in range(6):
        rnd = random.Random(seed)
        names = [f"n{i}.io" for i in range(12)]
        snap, keys = [], set()
        for _ in range(14):
            k = (rnd.choice(names), rnd.choice(["GD", "CF"]))
            if k in keys:
                continue
            keys.add(k)
            seen = _rand_day(rnd)
            snap.append({"domain": k[0], "src": k[1], "status": rnd.choice(["active", "removed"]),
                         "expiry_date": None, "discovery_date": seen - dt.timedelta(days=10), "last_seen": seen,
                         "raw_data": "old"})
        batch = [{"domain": rnd.choice(names), "expiry_date": None, "raw_data": f"r{i}"} for i in range(rnd.randint(0, 15))]
        model, stats = _model(snap, batch, "GD", lambda r: (r["domain"], r["src"]), ["expiry_date", "raw_data"], False)
        s_df = spark.createDataFrame([(r["domain"], r["src"], r["status"], r["expiry_date"], r["discovery_date"],
                                       r["last_seen"], r["raw_data"], None, None) for r in snap], DOMAINS_DDL)
        b_df = spark.createDataFrame([(b["domain"], b["expiry_date"], b["raw_data"], i) for i, b in enumerate(batch)],
                                     "domain string, expiry_date date, raw_data string, _ordinal long")
        m = M.merge_domains(s_df, b_df, "GD", TODAY)
        got = {(r["domain"], r["registrar"]): r for r in m.snapshot.collect()}
        assert set(got) == set(model), seed
        for k, r in model.items():
            g = got[k]
            assert (g["status"], g["last_seen"], g["discovery_date"], g["raw_data"]) == \
                (r["status"], r["last_seen"], r["discovery_date"], r["raw_data"]), (seed, k)
        st = m.stats.first()
        assert (st["added"], st["updated"], st["removed"]) == stats, seed


def test_dns_merge_matches_model(spark):
    for seed in range(6):
        rnd = random.Random(100 + seed)
        doms, subs = [f"d{i}.io" for i in range(4)], ["", "www", "mail"]
        snap, keys = [], set()
        for _ in range(16):
            k = (rnd.choice(doms), rnd.choice(subs), "A", rnd.choice(["1", "2"]), rnd.choice(["GD", "CF"]))
            if k in keys:
                continue
            keys.add(k)
            seen = _rand_day(rnd)
            snap.append({"domain": k[0], "sub": k[1], "type": "A", "data": k[3], "src": k[4],
                         "status": rnd.choice(["active", "removed"]), "ttl": 300,
                         "discovery_date": seen - dt.timedelta(days=5), "last_seen": seen})
        batch = [{"domain": rnd.choice(doms[:2]), "sub": rnd.choice(subs), "type": "A", "data": rnd.choice(["1", "2", "3"]),
                  "ttl": rnd.randint(1, 9)} for _ in range(rnd.randint(1, 10))]
        keyf = (lambda r: (r["domain"], r["sub"], "A", r["data"], r["src"]))
        model, stats = _model(snap, batch, "GD", keyf, ["ttl", "data", "type"], True)
        s_df = spark.createDataFrame([(r["domain"], r["sub"], "A", r["data"], r["ttl"], 0, r["src"], r["status"],
                                       r["discovery_date"], r["last_seen"], None, None, None) for r in snap], DNS_DDL)
        b_df = spark.createDataFrame([(b["domain"], b["sub"], "A", b["data"], b["ttl"], 0, None, i)
                                      for i, b in enumerate(batch)],
                                     "domain string, subdomain string, record_type string, data string, ttl int, "
                                     "priority int, raw_data string, _ordinal long")
        m = M.merge_dns_records(s_df, b_df, "GD", TODAY)
        got = {(r["domain"], r["subdomain"], "A", r["data"], r["source"]): r for r in m.snapshot.collect()}
        assert set(got) == set(model), seed
        for k, r in model.items():
            g = got[k]
            assert (g["status"], g["last_seen"], g["discovery_date"], g["ttl"]) == \
                (r["status"], r["last_seen"], r["discovery_date"], r["ttl"]), (seed, k)
        st = m.stats.first()
        assert (st["added"], st["updated"], st["removed"]) == stats, seed

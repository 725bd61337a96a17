"""Plan shapes that matter at scale: hot keys are combined before the
shuffle, broadcasts happen only behind a size check, per-group limits run
map-side, and no operator funnels a group into one window task."""

from pyspark.sql import functions as F

from skyledger.operators import merge as M
from skyledger.operators import runs as R
from skyledger.operators import unify as U
from skyledger.operators import views as V


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_batch_is_combined_map_side(spark):
    n = 30000
    batch = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot.io")).otherwise(F.concat(F.lit("d"), F.col("id").cast("string")))
        .alias("domain"), F.lit(None).cast("date").alias("expiry_date"),
        F.col("id").cast("string").alias("raw_data"), F.col("id").alias("_ordinal"))
    b = batch.withColumn("registrar", F.lit("GD"))
    d = M.dedupe_last(b, ["domain", "registrar"], "_ordinal")
    plan = _plan(d)
    assert "partial_max_by" in plan          # map-side combine before the exchange
    hot = d.filter(F.col("domain") == "hot.io").first()
    assert hot["_n"] == n // 3 and hot["raw_data"] == str(n - 3)


def test_scope_broadcast_is_the_planners_choice(spark):
    snap = spark.range(1000).select(F.concat(F.lit("d"), (F.col("id") % 50).cast("string")).alias("domain"),
                                    F.col("id"))
    dom = spark.range(10).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"))
    counts = []
    for threshold in ["10MB", "-1"]:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", threshold)
        try:
            scoped = M.scope_to_batch(snap, dom)
            assert ("BroadcastHashJoin" in _plan(scoped)) == (threshold != "-1")
            counts.append(scoped.filter("_scope").count())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert counts == [200, 200]


def test_top_hits_limit_runs_before_shuffle(spark):
    hits = spark.range(5000).select(F.lit("aws").alias("provider"),
                                    F.when(F.col("id") % 3 == 0, F.lit("big")).otherwise(F.lit("small"))
                                    .alias("service"), F.col("id").alias("_ordinal"))
    top = U.top_hits(hits, 10)
    plan = _plan(top)
    assert plan.count("WindowGroupLimit") >= 2
    got = {r["service"]: r["hits"] for r in top.collect()}
    assert got == {"big": 1667, "small": 3333}


def test_latest_runs_is_an_aggregation_not_a_window(spark):
    log = spark.range(3000).select(
        F.col("id").cast("string").alias("run_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 10).cast("string"))).alias("collector_name"),
        F.lit("dns").alias("service_type"), F.lit("completed").alias("status"),
        F.timestamp_seconds(F.col("id")).alias("started_at"))
    lr = R.latest_runs(log)
    plan = _plan(lr)
    assert "Window" not in plan and "partial_max_by" in plan
    assert {r["collector_name"]: r["run_id"] for r in lr.collect()}["hot"] == "2997"


def test_page_is_take_ordered(spark):
    df = spark.range(1000).select(F.col("id").alias("_ordinal"), F.col("id").cast("string").alias("v"))
    p = V.page(df, 3, 50, V.smart_order(df, "v"))
    assert "TakeOrderedAndProject" in _plan(p)


def test_bucketed_snapshot_is_not_shuffled_by_the_merge(spark, tmp_path):
    from skyledger.schemas import DNS_DDL, DNS_KEY
    from skyledger.sources.readers import BucketedSnapshot
    import datetime as dt
    d = dt.date(2024, 1, 1)
    rows = [(f"d{i % 50}.io", f"s{i}", "A", str(i), 300, 0, "GD", "active", d, d, None, None, None)
            for i in range(500)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = BucketedSnapshot(spark, str(tmp_path / "snap"), "t_bucket_snap", DNS_KEY[:4], parts, "source")
    store.commit(spark.createDataFrame(rows, DNS_DDL))
    batch = spark.createDataFrame([(f"d{i}.io", f"s{i}", "A", str(i), 60, 0, None, i) for i in range(0, 500, 7)],
                                  "domain string, subdomain string, record_type string, data string, ttl int, "
                                  "priority int, raw_data string, _ordinal long")
    batch.write.parquet(str(tmp_path / "batch"))      # a landed batch: its size is known to the planner
    batch = spark.read.parquet(str(tmp_path / "batch"))
    m = M.merge_dns_records(store.read(), batch, "GD", "2024-01-05")
    plan = _plan(m.source_rows)
    join = plan[plan.index("SortMergeJoin"):]
    snapshot_branch = join[:join.index("t_bucket_snap")]
    assert "Exchange" not in snapshot_branch.split("BroadcastExchange")[0]
    assert m.stats.first()["added"] + m.stats.first()["updated"] == len(range(0, 500, 7))


def test_search_index_prunes_providers(spark, tmp_path):
    from skyledger.operators.unify import Service, build_search_index, search_index
    a = spark.createDataFrame([(0, "red box", 5)], "_ordinal long, name string, n int")
    b = spark.createDataFrame([(0, "Red car", "active")], "_ordinal long, title string, status string")
    idx = build_search_index([Service("aws", "boxes", a), Service("gcp", "cars", b, "title")])
    idx.write.partitionBy("provider").parquet(str(tmp_path / "idx"))
    hits = search_index(spark.read.parquet(str(tmp_path / "idx")), " RED ", ["gcp"])
    plan = _plan(hits)
    assert "PartitionFilters: [isnotnull(provider" in plan and "gcp" in plan
    assert [(r["service"], r["name"], r["status_text"]) for r in hits.collect()] == [("cars", "Red car", "active")]
    assert search_index(spark.read.parquet(str(tmp_path / "idx")), "5", None).count() == 0   # numbers never match


def test_unbroadcast_scope_join_splits_a_hot_domain(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 30000
        snap = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot.io")).otherwise(F.concat(F.lit("d"), F.col("id").cast("string")))
            .alias("domain"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        dom = spark.range(0, n, 10).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain")).union(
            spark.createDataFrame([("hot.io",)], "domain string"))
        scoped = M.scope_to_batch(snap, dom)
        got = sum(1 for r in scoped.collect() if r["_scope"])          # runs this very plan to its final form
        plan = scoped._jdf.queryExecution().executedPlan().toString()
        assert got == n // 3 + len([i for i in range(0, n, 10) if i % 3 != 0])
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_status_sub_partition_prunes_removed_rows(spark, tmp_path):
    import datetime as dt
    from skyledger.schemas import DOMAINS_DDL
    from skyledger.sources.readers import SnapshotStore
    d = dt.date(2024, 1, 1)
    rows = [(f"d{i}.io", "GD", "removed" if i % 4 else "active", None, d, d, None, None, None) for i in range(40)]
    store = SnapshotStore(spark, str(tmp_path / "s"), "registrar", DOMAINS_DDL, "status")
    store.commit(spark.createDataFrame(rows, DOMAINS_DDL).drop("registrar").withColumn("registrar", F.lit("GD")), "GD")
    live = V.not_removed(store.read())
    assert live.count() == 10
    plan = _plan(live)
    assert "PartitionFilters" in plan and "removed" in plan.split("PartitionFilters")[1][:200]

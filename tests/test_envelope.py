"""The schema-free envelope against the schema-bound readers and searches."""

import json

import pytest
from pyspark.sql import functions as F

from skyledger.functions import expr as E
from skyledger.functions import variant as V
from skyledger.operators import unify as U
from skyledger.operators import views
from skyledger.sources import envelope as S
from skyledger.sources import readers as R

VALUES = [None, "", "text", 0, 1, -2.5, 1e20, 1e21, 1e-7, True, False, [], [1, None, "x", [2, [3]]], {}, {"k": 1}, "0", 12345678901234567890]


def test_values_follow_the_javascript_rules(spark):
    rows = [(json.dumps({"v": v}),) for v in VALUES] + [("{}",)]
    df = spark.createDataFrame(rows, "t string").select(F.expr("try_parse_json(t)").alias("row")).withColumn("f", V.fields("row"))
    got = [tuple(r) for r in df.select(V.field_text("f", "v"), V.field_first_truthy("f", ["v"], "-")).collect()]
    assert got == [(None, "-"), ("", "-"), ("text", "text"), ("0", "-"), ("1", "1"), ("-2.5", "-2.5"), ("100000000000000000000",) * 2, ("1e+21",) * 2,
                   ("1e-7",) * 2, ("true", "true"), ("false", "-"), ("", ""), ("1,,x,2,3",) * 2, ("[object Object]",) * 2, ("[object Object]",) * 2,
                   ("0", "0"), ("12345678901234567000",) * 2, (None, "-")]


def test_typed_and_schema_free_text_agree(spark):
    rows = [(1.5, 3, "a", True, [1, 2]), (0.0, 0, "", False, []), (1e20, -7, "b", None, None)]
    typed = spark.createDataFrame(rows, "d double, i long, s string, b boolean, a array<int>")
    free = typed.select("*", F.expr("parse_json(to_json(struct(*)))").alias("row")).withColumn("f", V.fields("row"))
    for c in ("d", "i", "s", "b", "a"):
        got = free.select(E.first_truthy(typed, [c], "-").alias("x"), V.field_first_truthy("f", [c], "-").alias("y")).collect()
        assert [r.x for r in got] == [r.y for r in got], c


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("catalog with space")
    vms = [{"vm_name": f"Web-{i}", "account": "a" if i % 2 else "", "size": i, "status": "active" if i % 3 else "removed", "tags": ["web-1"]} for i in range(40)]
    buckets = [{"bucket_name": f"bucket {i}", "zone": "eu-web" if i % 5 == 0 else "us", "meta": {"name": "web-1"}} for i in range(60)]
    (base / "vms.json").write_text(json.dumps(vms, indent=1))
    (base / "buckets.json").write_text("\n".join(map(json.dumps, buckets)) + "\n\n" + '{"bucket_name": "half\n[1, 2]\nnull\n')
    (base / "cut.json").write_text('[{"a": 1}, {"b"')
    (base / "object.json").write_text('  \n 5')
    (base / "empty.json").write_text("")
    return base


def _manifest(base):
    entry = lambda p, s, name=None: R.CatalogEntry(p, s, f"{base}/{s}.json", s.title(), f"{p}/{s}.html", name)
    return [entry("azure", "vms", "vm_name"), entry("aws", "buckets", "bucket_name"), entry("aws", "cut"), entry("aws", "object"), entry("aws", "empty"), entry("gcp", "gone")]


def test_envelope_reads_all_and_reports_the_rest(spark, files):
    e = S.read_envelope(spark, _manifest(files))
    got = e.rows.groupBy("provider", "service", "page", "name_field").count().collect()
    assert sorted(map(tuple, got)) == [("aws", "buckets", "aws/buckets.html", "bucket_name", 60), ("azure", "vms", "azure/vms.html", "vm_name", 40)]
    bad = sorted((r.service, r.reason, r.text) for r in e.errors.collect() if r.text is not None)
    assert bad == [("buckets", "not a JSON object", "[1, 2]"), ("buckets", "not a JSON object", "null"), ("buckets", "not a JSON object", '{"bucket_name": "half'),
                   ("cut", "not a JSON array", '[{"a": 1}, {"b"'), ("object", "not a JSON array", "  \n 5")]
    assert {r.service for r in e.errors.collect()} - {"empty"} == {"buckets", "cut", "object", "gone"}
    order = [r.row for r in e.rows.where("service = 'buckets'").orderBy("_ordinal").selectExpr("row:bucket_name::string AS row").collect()]
    assert order == [f"bucket {i}" for i in range(60)]


def test_search_on_the_envelope_equals_search_on_columns(spark, files):
    e = S.read_envelope(spark, _manifest(files))
    services, missing = R.read_catalog(spark, _manifest(files)[:2])
    columns = [c for c in U.global_search(services, "xx").columns if c != "_ordinal"]
    for q in ("web", "WEB-1", " us ", "1", "removed", "bucket 5", "é", "%"):
        want = sorted(map(tuple, U.global_search(services, q).select(columns).collect()))
        assert sorted(map(tuple, S.search_envelope(e.rows, q).select(columns).collect())) == want, q
    for providers in (["aws"], ["all"], []):
        want = U.global_search(services, "web", providers).count()
        assert S.search_envelope(e.rows, "web", providers).count() == want
    index = S.envelope_index(e.rows)
    assert sorted(r.name for r in U.search_index(index, "web-1").collect()) == sorted(r.name for r in U.global_search(services, "web-1").collect())
    view = views.match_any_string(services[0].df, "web-1").count()
    assert S.match_envelope(e.rows.where("service = 'vms'"), "web-1").count() == view


def test_one_scan_for_each_layout(spark, files):
    plan = S.search_envelope(S.read_envelope(spark, _manifest(files)).rows, "web")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 2 and "Exchange hash" not in plan


def test_lines_are_split_and_keep_their_order(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(json.dumps({"n": i, "pad": "x" * (i % 700)}) + "\n" for i in range(20000)) + '{"n": "text"}\n{"n": 1')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 20)
    try:
        rows, errors = S.read_lines(spark, str(path), "n LONG, pad STRING")
        assert rows.rdd.getNumPartitions() >= 6
        got = rows.select("n", "_ordinal").collect()
        assert len({r._ordinal for r in got}) == 20000
        assert [r.n for r in sorted(got, key=lambda r: r._ordinal)] == list(range(20000))
        assert sorted(r.text for r in errors.collect()) == ['{"n": "text"}', '{"n": 1']
        assert R.read_assets(spark, str(path), "n LONG").count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_empty_catalog(spark):
    e = S.read_envelope(spark, [])
    assert e.rows.count() == 0 and e.errors.count() == 0
    assert S.search_envelope(e.rows, "web").count() == 0

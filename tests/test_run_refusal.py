"""A collector whose run is running refuses another; metadata is one document."""

import pytest

from skyledger.collection import CollectionStores, RunInProgress, _append, read_run_log, run_collection
from skyledger.operators import runs as R
from skyledger.schemas import DNS_DDL, DOMAINS_DDL, RUN_LOG_DDL
from skyledger.sources import readers as S
from skyledger.sources import sinks as K


def test_second_run_is_refused(spark, tmp_path):
    stores = CollectionStores(S.SnapshotStore(spark, f"{tmp_path}/d", "registrar", DOMAINS_DDL),
                              S.SnapshotStore(spark, f"{tmp_path}/r", "source", DNS_DDL), f"{tmp_path}/runs")
    empty = spark.createDataFrame([], RUN_LOG_DDL)
    _append(R.open_run(empty, "first", "godaddy", "dns", "manual", "2024-01-01 00:00:00", 1), stores.run_log_dir)
    docs = spark.createDataFrame([("p", '[{"domain": "a.io"}]')], "_doc string, value string")
    recs = spark.createDataFrame([], "_doc string, domain string, value string")
    with pytest.raises(RunInProgress):
        run_collection(spark, stores, "GoDaddy", docs, recs, "2024-01-01", "2024-01-01 00:01:00", "second", 3)
    assert read_run_log(spark, stores.run_log_dir).count() == 1
    out = run_collection(spark, stores, "GoDaddy", docs, recs, "2024-01-01", "2024-01-01 00:01:00", "first", 3)
    assert out.first()["status"] == "completed"


def test_metadata_document_round_trip(spark, tmp_path):
    flat = spark.createDataFrame(
        [("aws", "AWS", "Amazon", "daily", "t1", "ec2", "t2", 3), ("aws", "AWS", "Amazon", "daily", "t1", "s3", "t3", None),
         ("gcp", "GCP", "Google", "weekly", "t4", None, None, None)],
        "provider_key string, name string, provider string, schedule string, provider_last_updated string, "
        "service string, last_updated string, count bigint")
    K.export_metadata(flat, f"{tmp_path}/m", "now", document=True)
    assert spark.read.text(f"{tmp_path}/m").count() == 1
    back = R.read_metadata(spark, f"{tmp_path}/m")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, flat.collect()), key=str)
    (tmp_path / "meta.json").write_text('{\n  "services": {\n    "aws": {\n      "name": "AWS",\n      "services": {\n'
                                        '        "ec2": {"last_updated": "x"}\n      }\n    }\n  }\n}\n')
    assert [r["service"] for r in R.read_metadata(spark, str(tmp_path / "meta.json")).collect()] == ["ec2"]


def test_csv_parts_hold_one_header(spark, tmp_path):
    from skyledger.operators.views import ViewSpec
    view = ViewSpec.of("t", "name note")
    df = spark.createDataFrame([("b", 'say "x", y'), ("a", None)], "name string, note string").orderBy("name")
    K.export_csv(df, view, f"{tmp_path}/c")
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text == 'Name,Note\na,\nb,"say ""x"", y"\n'

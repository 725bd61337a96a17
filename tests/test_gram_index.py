"""Searches through the n-gram index equal full scans."""

import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import gram_index as G
from skyledger.operators import views as V


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = random.Random(4)
    words = ["web", "db-1", "Prod", "eu-west-1", "é", "中文", "x", "", "a b", "00", "𝄞𝄞x"]
    rows = [(i, [None if rnd.random() < 0.05 else "".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))).lower() for _ in range(rnd.randint(0, 4))]
             if rnd.random() < 0.95 else None) for i in range(3000)]
    rows.append((9000, ["only here needle-77"]))
    df = spark.createDataFrame(rows, "asset int, _strings array<string>").repartition(8, "asset")
    path = str(tmp_path_factory.mktemp("grams") / "index")
    G.build_gram_index(df, "_strings", path)
    return df, path


@pytest.mark.parametrize("q", ["we", "WEB", "b-", "db-1db-1", "é中", "中文", "00", "000", " a b ", "𝄞x", "needle-77", "needle-78", "zz", "west-1prod", "1", "", None, "00000000", "a b web"])
def test_hits_equal_the_scan(spark, index, q):
    df, path = index
    needle = (q or "").strip().lower()
    want = sorted(r.asset for r in df.where(F.exists("_strings", lambda x: x.contains(needle))).collect()) if len(needle) >= 2 else []
    got = G.search_grams(spark, path, "_strings", q)
    assert got.columns == df.columns
    assert sorted(r.asset for r in got.collect()) == want


def test_a_rare_needle_reads_few_rows(spark, index):
    df, path = index
    got = G.search_grams(spark, path, "_strings", "needle-77")
    assert [r.asset for r in got.collect()] == [9000]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(_block" in plan or "EqualTo(_block" in plan
    assert "In(gram" in plan or "EqualTo(gram" in plan


def test_row_text_across_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, "acct", "Web-1", 0), (2, "acct", "web-2", 5), (3, None, "db", 7)], "_ordinal long, account string, name string, n int")
    view = V.ViewSpec.of("t", "account name n")
    rows = df.withColumn("_strings", F.array(V.row_text(df, view)))
    G.build_gram_index(rows, "_strings", str(tmp_path / "i"))
    for q in ("acct web-2", "ct w", "b 7", "2 5", "xx"):
        want = sorted(r[0] for r in V.search_rows(df, q, view).select("_ordinal").collect())
        assert sorted(r._ordinal for r in G.search_grams(spark, str(tmp_path / "i"), "_strings", q).collect()) == want


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "asset int, _strings array<string>")
    G.build_gram_index(df, "_strings", str(tmp_path / "i"))
    assert G.search_grams(spark, str(tmp_path / "i"), "_strings", "ab").count() == 0


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    """The pieces of a small file of many rows are found by more than one task, in lists ahead of the shuffle."""
    df = spark.range(0, 40000, 1, 1).select("id", F.array(F.concat(F.lit("row "), "id")).alias("_strings"))
    stored = df.withColumnRenamed("id", "_id")
    plan = G.posting_lists(stored, "_strings")._jdf.queryExecution().executedPlan().toString()
    found, dealt = plan.index("MapInArrow"), plan.index("hashpartitioning(shiftright(_id")
    assert found < dealt and "Generate explode" not in plan
    G.build_gram_index(df, "_strings", str(tmp_path / "i"))
    lists = spark.read.parquet(str(tmp_path / "i" / "postings"))
    assert lists.where("gram = 'ro'").agg(F.sum("n")).first()[0] == 40000
    assert G.search_grams(spark, str(tmp_path / "i"), "_strings", "row 39999").count() == 1


@pytest.mark.parametrize("rows, letters", [(300, 5), (5000, 150000)])
def test_pieces_equal_brute_force(rows, letters):
    """Texts of several services, with nulls and rows without any; also with more characters than a packed key can hold."""
    import pyarrow as pa

    rnd = random.Random(rows)
    every = [chr(0x10000 + k) for k in range(letters)]
    def text():
        return None if rnd.random() < 0.1 else "".join(rnd.choice(every) for _ in range(rnd.randint(0, 60)))

    ids = rnd.sample(range(3 << G.BLOCK_BITS), rows)
    texts = [None if rnd.random() < 0.1 else [text() for _ in range(rnd.randint(0, 3))] for _ in ids]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["_id", "texts"])
    got = set()
    for part in G._pieces(iter([batch.slice(0, 7), batch.slice(7)])):
        for r in part.to_pylist():
            assert r["ids"] == sorted(set(r["ids"]))
            rows_of = {(r["gram"], (r["_block"] << G.BLOCK_BITS) + k) for k in r["ids"]}
            assert not rows_of & got
            got |= rows_of
    assert got == {(t[k : k + n], i) for i, ts in zip(ids, texts) for t in ts or [] if t for n in (2, 3) for k in range(len(t) - n + 1)}


@pytest.mark.parametrize("rows, size, least", [(100000, 1, 4), (400, 60000, 4)])
def test_tasks_follow_the_rows_and_their_texts(spark, rows, size, least):
    """The planner does not join the tasks that find the pieces; long texts are dealt in fewer rows at a time."""
    stored = spark.range(0, rows, 1, 1).select(F.col("id").alias("_id"), F.array(F.repeat(F.lit("x"), size), F.lit(None).cast("string")).alias("_strings"))
    got = G.dealt(stored, "_strings")
    held = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in held) == rows
    assert len(held) >= least and max(r["count"] for r in held) < rows * 0.7
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()

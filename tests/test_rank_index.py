"""Pages by rank equal pages by offset."""

import re

import pytest
from pyspark.sql import functions as F

from skyledger.operators import ranking as R
from skyledger.operators import views as V


@pytest.fixture(scope="module")
def frame(spark):
    k = F.col("id")
    return spark.range(3000).select(
        k.alias("_ordinal"), F.when(k % 3 == 0, F.lit("same")).when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.lit(""))
        .when(k % 2 == 0, F.concat((k * 37 % 1000).cast("string"), F.lit(" GB"))).otherwise(F.concat(F.lit("Host-"), (k % 91).cast("string"))).alias("v"),
        F.when(k % 11 > 0, (k * 7919 % 1009) / 4).alias("n"))


@pytest.mark.parametrize("column", ["v", "n"])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_by_rank_equal_pages_by_offset(spark, frame, tmp_path, column, direction):
    path, order = str(tmp_path / "rank"), V.smart_order(frame, column, direction)
    R.build_rank_index(frame, order, path, ranges=13)
    for page_no, rows in [(0, 50), (1, 50), (7, 250), (59, 50), (60, 50), (11, 250), (12, 250), (500, 100), (0, 5000), (2999, 1)]:
        want = V.page(frame, page_no, rows, order, position="pos").orderBy("pos").collect()
        assert R.page_by_rank(spark, path, page_no, rows, position="pos").collect() == want, (page_no, rows)
        assert R.rank_summary(spark, path, page_no, rows).collect() == V.page_summary(frame, page_no, rows).collect()
    assert R.page_by_rank(spark, path, 0, -1).collect() == V.page(frame, 0, -1, order).collect()
    # a value that a third of the rows share is cut into several ranges
    sizes = [r["n"] for r in spark.read.parquet(f"{path}/ranges").collect()]
    assert max(sizes) < 3 * 3000 / 13


def test_a_deep_page_reads_its_ranges_only(spark, tmp_path):
    df = spark.range(400_003).withColumnRenamed("id", "_ordinal").withColumn("v", F.pmod(F.xxhash64("_ordinal"), F.lit(10**6)))
    path, order = str(tmp_path / "rank"), V.smart_order(df, "v", "desc")
    R.build_rank_index(df, order, path, ranges=16)
    page = R.page_by_rank(spark, path, 200_000, 2)
    rows, plan = page.collect(), page._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 2 and rows == V.page(df, 200_000, 2, order).collect()
    assert "Offset" not in plan and re.findall(r"limit=(\d+)", plan)[0] == "2"
    ranges = re.search(r"PartitionFilters: \[.*?\]", plan)[0]
    assert len(set(re.findall(r"_range#\d+ (?:=|IN) \(?([\d,]+)", ranges)[0].split(","))) <= 2
    assert re.search(r"PushedFilters: \[[^\]]*_rank", plan)


def test_empty_and_bad_pages(spark, frame, tmp_path):
    path = str(tmp_path / "none")
    R.build_rank_index(frame.limit(0), V.smart_order(frame, "v"), path, ranges=3)
    assert R.page_by_rank(spark, path, 0, 50).count() == 0 and R.page_by_rank(spark, path, 0, -1).count() == 0
    assert R.rank_summary(spark, path, 0, 50).first().asDict() == {"from_row": 0, "to_row": 0, "total": 0, "pages": 1}
    with pytest.raises(ValueError):
        R.page_by_rank(spark, path, -1, 50)

"""View engine: smart sort against a brute-force model, paging, CSV text."""

import functools
import os
import random
import re
import tempfile


from skyledger.operators import views as V
from skyledger.sources import sinks as K

_NUM = re.compile(r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def _parse_float(s):
    m = _NUM.match(s)
    return float(m.group(1)) if m else None


def _bucket_key(v, desc):
    t = ("" if v is None else v).lower()
    n = _parse_float(t)
    b = 1 if n is not None else (0 if t < "0" else 2)
    return b, n, t


def _model(rows, desc):
    """Stable sort by the documented total order (bucket, number or text)."""
    def cmp(a, b):
        ka, kb = _bucket_key(a[1], desc), _bucket_key(b[1], desc)
        if ka[0] != kb[0]:
            r = -1 if ka[0] < kb[0] else 1
        elif ka[0] == 1:
            r = (ka[1] > kb[1]) - (ka[1] < kb[1])
        else:
            r = (ka[2] > kb[2]) - (ka[2] < kb[2])
        return -r if desc else r
    return [r[0] for r in sorted(rows, key=functools.cmp_to_key(cmp))]


def test_smart_sort_matches_model(spark):
    rnd = random.Random(3)
    pool = ["10", "9", "2.5", "-1", "", None, "-", "abc", "Abd", "10.0.0.1", "10.0.0.2", "2025-01-10",
            "2024-12-31", "zeta", ".5", "1e3", "x1", " 7", "!", "ß"]
    rows = [(i, rnd.choice(pool)) for i in range(300)]
    df = spark.createDataFrame(rows, "_ordinal long, v string")
    for desc in (False, True):
        got = [r[0] for r in V.smart_sort(df, "v", "desc" if desc else "asc").collect()]
        assert got == _model(rows, desc)


def test_smart_sort_all_numbers_is_numeric(spark):
    rows = [(i, str(v)) for i, v in enumerate([100, 20, 3, -4, 55.5, 0])]
    df = spark.createDataFrame(rows, "_ordinal long, v string")
    assert [r[1] for r in V.smart_sort(df, "v").collect()] == ["-4", "0", "3", "20", "55.5", "100"]


def test_page_and_summary(spark):
    df = spark.createDataFrame([(i, f"n{i:03d}") for i in range(120)], "_ordinal long, v string")
    order = V.smart_order(df, "v")
    p = V.page(df, 2, 50, order, position="pos").collect()
    assert [r["pos"] for r in p] == list(range(101, 121))
    s = V.page_summary(df, 2, 50).first().asDict()
    assert s == {"from_row": 101, "to_row": 120, "total": 120, "pages": 3}
    allrows = V.page(df, 0, -1, order).count()
    assert allrows == 120
    k = V.page_after(df, ["v"], ("n049",), 10).collect()
    assert [r["v"] for r in k][0] == "n050"


def test_filters(spark):
    df = spark.createDataFrame([(1, "acct", "Web-1", "removed", 0), (2, "acct", "web-2", None, 5),
                                (3, "other", "db", "active", 0)],
                               "_ordinal long, account string, name string, status string, n int")
    view = V.ViewSpec.of("t", "account name n")
    assert V.not_removed(df).count() == 2
    assert V.only_removed(df).count() == 1
    assert V.filter_account(df, "acct").count() == 2
    assert V.filter_columns(df, {"name": "WEB"}).count() == 2
    assert V.filter_columns(df, {"n": "0"}).count() == 0           # 0 is falsy -> ''
    assert V.search_rows(df, "acct web-2", view).count() == 1       # spans two cells
    assert [r[0] for r in V.accounts(df).collect()] == ["acct", "other"]


def test_csv_export_quoting(spark):
    df = spark.createDataFrame([(1, 'say "hi"', "a,b", None, 0, False, ["x", "y"]),
                                (2, "plain", " pad ", "line\nbreak", 3, True, [])],
                               "_ordinal long, a string, b string, c string, n int, f boolean, g array<string>")
    view = V.ViewSpec.of("t", "a b c n f g")
    out = os.path.join(tempfile.mkdtemp(), "csv")
    K.export_csv(df.orderBy("_ordinal"), view, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    lines = [ln for ln in text.split("\n") if ln and ln != "A,B,C,N,F,G"]
    assert '"say ""hi""","a,b",,0,false,"x,y"' in lines
    assert 'plain, pad ,"line' in text and 'break",3,true,' in text


def test_view_catalog_projects_absent_fields(spark):
    from skyledger.catalog import VIEWS, with_renders
    from skyledger.functions import render as R
    assert len(VIEWS) == 123
    ec2 = with_renders(VIEWS["aws/ec2"], {"public_ip": lambda d, f: R.or_default(d, f, "-")})
    df = spark.createDataFrame([(1, "i-1", "web", "t3", "running", "10.0.0.1", None, "us-east-1", "active", None)],
                               "_ordinal long, instance_id string, name string, instance_type string, state string, "
                               "private_ip string, public_ip string, region string, status string, "
                               "discovery_date string")
    row = V.table_view(df, ec2).first().asDict()
    assert row["account"] is None and row["public_ip"] == "-" and row["name"] == "web"
    # the catalog's own renderers: Yes/No labels, defaults and badge classes
    from skyledger.catalog import state_classes
    rds = spark.createDataFrame([(1, "db1", True, None, "available")],
                                "_ordinal long, db_identifier string, multi_az boolean, encrypted boolean, "
                                "status string")
    r = V.table_view(rds, VIEWS["aws/rds"]).first().asDict()
    assert (r["multi_az"], r["encrypted"]) == ("Yes", "No")
    cls = df.select(*state_classes(df, "aws/ec2")).first()[0]
    assert cls == "running"


def test_parquet_ordinal_is_file_and_row(spark, tmp_path):
    from skyledger.sources.readers import read_parquet_with_ordinal
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = read_parquet_with_ordinal(spark, str(tmp_path / "p")).orderBy("_ordinal").collect()
    assert [r["id"] for r in rows] == list(range(10))
    assert [r["_ordinal"]["row"] for r in rows] == list(range(10))


def test_commit_replaces_a_failed_attempt(spark, tmp_path):
    from skyledger.sources import readers as S
    base = str(tmp_path / "snap")
    assert S.commit_snapshot(spark.range(3).withColumnRenamed("id", "x"), base) == 0
    os.makedirs(os.path.join(base, "v=1", "_temporary"))          # a crashed attempt of version 1
    assert S.commit_snapshot(spark.range(5).withColumnRenamed("id", "x"), base) == 1
    assert S.read_snapshot(spark, base).count() == 5


def test_hidden_columns_are_searched_not_shown(spark):
    df = spark.createDataFrame([(0, "a", "secret-x"), (1, "b", "other")], "_ordinal long, name string, note string")
    view = V.ViewSpec.of("t", "name note")
    page = V.table_view(df, view, search="secret", hidden=[1])
    assert page.columns == ["_ordinal", "name"] and [r["name"] for r in page.collect()] == ["a"]

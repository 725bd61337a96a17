"""Scalar expressions on hand-written rows (edge cases of the Go and JS rules)."""

from pyspark.sql import functions as F

from skyledger.functions import expr as E


def _one(spark, col, rows, ddl="v string"):
    df = spark.createDataFrame(rows, ddl)
    return [r[0] for r in df.select(col(df)).collect()]


def test_is_test_domain(spark):
    rows = [("example.com",), (" Example.COM\t",), ("staging-api.io",), ("Demo.shop.io",),
            ("mytest-site.com",), ("localhost",), ("devices.io",), (None,), ("dev-x.org",)]
    got = _one(spark, lambda d: E.is_test_domain("v"), rows)
    assert got == [True, True, True, True, False, True, False, False, True]


def test_normalize_subdomain_and_type(spark):
    rows = [("@",), (" @ ",), ("\tWWW\n",), ("",), ("Mail",)]
    assert _one(spark, lambda d: E.normalize_subdomain("v"), rows) == ["", "", "www", "", "mail"]
    assert _one(spark, lambda d: E.normalize_record_type("v"), [(" cname\t",), ("a",)]) == ["CNAME", "A"]


def test_extract_subdomain(spark):
    df = spark.createDataFrame([("example.io", "example.io"), ("www.example.io.", "Example.io"),
                                ("a.b.example.io", "example.io."), ("other.net", "example.io"),
                                ("notexample.io", "example.io"), ("x.example.io..", "example.io")],
                               "h string, d string")
    got = [r[0] for r in df.select(E.extract_subdomain("h", "d")).collect()]
    assert got == ["", "www", "a.b", "other.net", "notexample.io", "x.example.io."]


def test_fqdn_and_details(spark):
    df = spark.createDataFrame([("", "a.io", "A", "1.2.3.4"), ("www", "a.io", "CNAME", "x")],
                               "s string, d string, t string, v string")
    got = df.select(E.fqdn("s", "d"), E.record_details("t", "v")).collect()
    assert [tuple(r) for r in got] == [("a.io", "A record - 1.2.3.4"), ("www.a.io", "CNAME record - x")]


def test_num_prefix_matches_parse_float(spark):
    cases = {"10.0.0.1": 10.0, "2025-01-10": 2025.0, "-": None, "": None, "  7px": 7.0, ".5": 0.5,
             "-3e2x": -300.0, "1e": 1.0, "abc": None, "+4": 4.0, "v1.2": None}
    rows = [(k,) for k in cases]
    got = _one(spark, lambda d: E.num_prefix("v"), rows)
    assert got == list(cases.values())


def test_rfc3339_date_as_written(spark):
    rows = [("2026-03-04T23:30:00-07:00",), ("2026-03-04T01:00:00Z",), ("2026-03-04",), ("",),
            ("2026-13-04T01:00:00Z",), ("garbage",), (None,)]
    got = _one(spark, lambda d: E.format_date(E.parse_rfc3339_date("v")), rows)
    assert got == ["2026-03-04", "2026-03-04", None, None, None, None, None]


def test_trim_unicode(spark):
    rows = [("  a b\t\n",), ("x",)]
    assert _one(spark, lambda d: E.trim_unicode("v"), rows) == ["a b", "x"]


def test_truthy_and_cell_text(spark):
    df = spark.createDataFrame([(0, 0.0, False, "", [], None), (2, 1.5, True, "x", ["a", "b"], {"k": "v"})],
                               "i int, f double, b boolean, s string, a array<string>, m map<string,string>")
    truth = df.select(*[E.truthy(df, c).alias(c) for c in df.columns]).collect()
    assert tuple(truth[0]) == (False, False, False, False, True, False)
    assert tuple(truth[1]) == (True, True, True, True, True, True)
    text = df.select(*[E.cell_text(df, c).alias(c) for c in df.columns]).collect()
    assert tuple(text[0]) == ("", "", "", "", "", "")
    assert tuple(text[1]) == ("2", "1.5", "true", "x", "a,b", "[object Object]")


def test_js_string_integral_double(spark):
    df = spark.createDataFrame([(73.0,), (1863.84,), (-2.0,)], "v double")
    assert [r[0] for r in df.select(E.js_string(df, "v")).collect()] == ["73", "1863.84", "-2"]


def test_first_truthy_and_service_label(spark):
    df = spark.createDataFrame([("", "disp", "k_a_b"), (None, None, "x-y-z")], "name string, d string, key string")
    got = df.select(E.first_truthy(df, ["name", "d", "absent"], "N/A"),
                    E.service_label(F.col("key"), "upper_first_underscore"),
                    E.service_label(F.col("key"), "upper_first_dash"),
                    E.service_label(F.col("key"), "capitalize")).collect()
    assert tuple(got[0]) == ("disp", "K A_B", "K_A_B", "K_a_b")
    assert tuple(got[1]) == ("N/A", "X-Y-Z", "X Y-Z", "X-y-z")

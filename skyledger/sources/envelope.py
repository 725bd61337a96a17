"""Schema-free reading of many services at once (S1, S2): rows as Variant in one envelope.

Services differ in their fields, and nothing here needs to know them: every
array element or line becomes one row of one table, with the catalog entry it
belongs to. All array files of a catalog are one scan and all line files are
another, however many services there are.

A file of JSON lines is split like any text file, so a large one is many tasks;
a JSON array is one document and one task. What does not parse is never
dropped silently: it is a row of the second frame, with its file and the text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import variant as X
from skyledger.operators.views import filter_providers

ROWS_DDL = ("provider string, service string, label string, page string, name_field string, row variant, "
            "_file string, _ordinal long")
ERRORS_DDL = "provider string, service string, _file string, _ordinal long, reason string, text string"
_PEEK = 4096  # bytes looked at for the first character of a file


class Envelope(NamedTuple):
    """``rows`` in the columns of ``ROWS_DDL``; ``errors`` (of ``ERRORS_DDL``) what could not be read."""

    rows: DataFrame
    errors: DataFrame


def _data_files(spark: SparkSession, path: str) -> list:
    """File statuses a path, folder or glob names, hidden ones left out (a listing; no data is read)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], list(fs.globStatus(where) or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            names = [(s, s.getPath().getName()) for s in fs.listStatus(status.getPath())]
            todo += [s for s, name in names if not name.startswith(".") and (not name.startswith("_") or "=" in name)]
        else:
            out.append(status)
    return out


def _first_character(spark: SparkSession, status) -> str:
    """The first character of a file that is no white space ("" if there is none among the first ``_PEEK``)."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(status.getPath())
    stream = status.getPath().getFileSystem(conf).open(status.getPath())
    try:
        stream = codec.createInputStream(stream) if codec else stream
        for _ in range(_PEEK):
            byte = stream.read()
            if byte < 0:
                break
            if chr(byte) not in " \t\r\n":
                return chr(byte)
    finally:
        stream.close()
    return ""


def layout_of(spark: SparkSession, path: str) -> str | None:
    """"lines" if the first file with content starts with ``{``, else "array"; None without any file."""
    files = _data_files(spark, path)
    for status in sorted(files, key=lambda s: s.getPath().toString()):
        if status.getLen():
            return "lines" if _first_character(spark, status) == "{" else "array"
    return "array" if files else None


def files_by_layout(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(array files, JSON-lines files) below a path, each told by its own first character; other files are in neither."""
    found: dict[str, list[str]] = {"[": [], "{": []}
    for status in _data_files(spark, path):
        found.get(_first_character(spark, status), []).append(status.getPath().toString())
    return found["["], found["{"]


def _uri(c: Column) -> Column:
    """File locations written alike, whoever names them (``file:/x`` and ``file:///x``)."""
    return F.regexp_replace(c, "^([A-Za-z][A-Za-z0-9+.-]*):/+(?=[^/])", "$1:/")


def line_ordinal() -> Column:
    """A line's number for ordering within its file, from a text scan.

    The byte at which the line's split starts, plus the rows ahead of it in its
    task: a task reads no more rows than a split has bytes, so the numbers of a
    later split are larger.
    """
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("_file"), line_ordinal().alias("_ordinal"),
                                         "value").filter(F.trim("value") != "")


def read_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (rows, errors): typed by ``schema``, or as one Variant column ``row``.

    A line that is no JSON object, or does not fit the schema, is in ``errors``
    (_file, _ordinal, text) and not in ``rows``.
    """
    lines = _lines(spark, [path] if isinstance(path, str) else path)
    if schema is None:
        parsed = lines.withColumn("row", F.try_parse_json("value"))
        ok = F.coalesce(F.startswith(F.schema_of_variant("row"), F.lit("OBJECT")), F.lit(False))
        rows = parsed.filter(ok).select("row", "_file", "_ordinal")
    else:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
        parsed = lines.withColumn("row", F.from_json("value", whole, {"columnNameOfCorruptRecord": "_corrupt"}))
        ok = F.col("row").isNotNull() & F.col("row._corrupt").isNull()
        rows = parsed.filter(ok).select(*[F.col(f"row.`{f.name}`") for f in schema.fields], "_file", "_ordinal")
    return rows, parsed.filter(~ok).select("_file", "_ordinal", F.col("value").alias("text"))


def read_envelope(spark: SparkSession, manifest: list) -> Envelope:
    """All entries of ``manifest`` (``CatalogEntry``) as one envelope.

    The files of one entry share a layout, told by the first one's first character.
    """
    places: dict[str, list[tuple]] = {"array": [], "lines": []}
    paths: dict[str, list[str]] = {"array": [], "lines": []}
    missing = []
    for e in manifest:
        files = _data_files(spark, e.path)
        layout = layout_of(spark, e.path) if files else None
        if layout is None:
            missing.append((e.provider, e.service, e.path, None, "missing", None))
            continue
        places[layout] += [(s.getPath().toUri().toString(), e.provider, e.service, e.label, e.page, e.name_field) for s in files]
        paths[layout] += [s.getPath().toString() for s in files]
    entry = "place string, provider string, service string, label string, page string, name_field string"
    rows, errors = [], [spark.createDataFrame(missing, ERRORS_DDL)]
    told = ["provider", "service"]
    for layout in ("array", "lines"):
        if not paths[layout]:
            continue
        # one row for each listed file; the driver holds that list already
        owner = F.broadcast(spark.createDataFrame(places[layout], entry).withColumn("place", _uri(F.col("place"))))
        if layout == "lines":
            found = _lines(spark, paths[layout])
            parsed = found.withColumn("row", F.try_parse_json("value")).withColumn(
                "_good", F.coalesce(F.startswith(F.schema_of_variant("row"), F.lit("OBJECT")), F.lit(False)))
            reason = F.lit("not a JSON object")
        else:
            found = spark.read.text(paths[layout], wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
            docs = found.withColumn("items", F.expr("from_json(value, 'array<variant>')"))
            docs = docs.withColumn("_good", F.startswith(F.ltrim("value"), F.lit("[")) & F.col("items").isNotNull())
            parsed, reason = docs, F.lit("not a JSON array")
        parsed = parsed.join(owner, _uri(F.col("_file")) == F.col("place"))
        bad = parsed.filter(~F.coalesce("_good", F.lit(False)))
        ordinal = F.col("_ordinal") if layout == "lines" else F.lit(None).cast("long").alias("_ordinal")
        errors.append(bad.select(*told, "_file", ordinal, reason.alias("reason"), F.col("value").alias("text")))
        good = parsed.filter("_good")
        if layout == "array":
            good = good.select("*", F.posexplode("items").alias("_pos", "row")).withColumn("_ordinal", F.col("_pos").cast("long"))
        rows.append(good.select(*told, "label", "page", "name_field", "row", "_file", "_ordinal"))
    if not rows:
        one = spark.range(0).select(F.expr("parse_json('{}')").alias("row"))
        empty = one.select(*[F.lit(None).cast("string").alias(c) for c in (*told, "label", "page", "name_field")], "row",
                           F.lit(None).cast("string").alias("_file"), F.lit(None).cast("long").alias("_ordinal"))
        rows.append(empty)
    out = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    bad = errors[0]
    for e in errors[1:]:
        bad = bad.unionByName(e)
    return Envelope(out, bad)


# F9 / G1 / U2 on the envelope ----------------------------------------------------
def match_envelope(rows: DataFrame, q: str | None) -> DataFrame:
    """rows with a top-level string value that contains ``q``."""
    q = (q or "").strip()
    if len(q) < 2:
        return rows.filter(F.lit(False))
    return rows.withColumn("_fields", X.fields("row")).filter(X.any_string_contains("_fields", q.lower())).drop("_fields")


def _hit_columns() -> list[Column]:
    status = X.field_text("_fields", "status")
    return [F.col(c) for c in ("provider", "service", "page")] + [
        X.field_first_truthy("_fields", ["name", "id"], "Unknown", dynamic="name_field").alias("name"),
        X.field_first_truthy("_fields", ["account"], "-").alias("account"),
        X.field_first_truthy("_fields", ["region", "location", "zone"], "").alias("region"),
        F.when(status == "active", F.lit("active")).otherwise(F.lit("removed")).alias("status_class"),
        X.field_first_truthy("_fields", ["status"], "unknown").alias("status_text"), F.col("_ordinal")]


def search_envelope(rows: DataFrame, q: str | None, providers=None) -> DataFrame:
    """G1: the hit rows of every service, in one scan of the envelope."""
    return match_envelope(filter_providers(rows, providers), q).withColumn("_fields", X.fields("row")).select(*_hit_columns())


def envelope_index(rows: DataFrame) -> DataFrame:
    """The search index of ``unify.build_search_index``, from an envelope."""
    return rows.withColumn("_fields", X.fields("row")).select(
        *_hit_columns(), F.coalesce(X.string_values("_fields"), F.array().cast("array<string>")).alias("_strings"))

"""Provider responses -> typed domain and DNS record rows.

Input is landed response text (one JSON document per row, as read by
``sources.read_landed``). Every element keeps its raw JSON as ``raw_data``
and an ordinal ``(_doc, _pos)`` so first-seen rules are deterministic.
Fields are read through a Variant so their JSON type is checked the way the
collectors assert it (a number where a string is expected counts as absent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.expr import (extract_subdomain, is_test_domain, is_valid_record_type,
                                      normalize_record_type, normalize_subdomain,
                                      parse_rfc3339_date)
from skyledger.operators.merge import dedupe_first

GODADDY = "GoDaddy"
CLOUDFLARE = "Cloudflare"
ERROR_CHARS = 200  # of a page that cannot be read, in the message about it


def _elements(docs: DataFrame, value: str = "value", doc: str = "_doc") -> DataFrame:
    """Explode a JSON array document into raw element text with its position."""
    arr = F.from_json(F.col(value), "array<string>")
    keep = [c for c in docs.columns if c != value]
    return docs.select(*keep, F.posexplode_outer(arr).alias("_pos", "raw_data")).filter(
        F.col("raw_data").isNotNull())


def _parsed(df: DataFrame) -> DataFrame:
    """Parse each element's JSON once into a Variant (``_v``) so field types
    are known: the collectors accept a field only when its JSON type is the
    expected one."""
    return df.withColumn("_v", F.try_parse_json(F.col("raw_data")))


def _json_type(name: str):
    return F.schema_of_variant(F.try_variant_get(F.col("_v"), f"$.{name}", "variant"))


def _field(name: str):
    """Go ``v.(string)``: the value when it is a JSON string, else null."""
    return F.when(_json_type(name) == "STRING", F.try_variant_get(F.col("_v"), f"$.{name}", "string"))


def _as_int(name: str):
    """Go ``int(v.(float64))``: JSON numbers truncate, anything else (and
    a number beyond the int range) is 0."""
    t = _json_type(name)
    numeric = t.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | t.startswith("DECIMAL")
    v = F.when(numeric, F.try_variant_get(F.col("_v"), f"$.{name}", "double"))
    return F.coalesce(v.try_cast("int"), F.lit(0))


def _dated(df: DataFrame, as_of) -> DataFrame:
    d = F.lit(str(as_of)).cast("date")
    return df.withColumn("discovery_date", d).withColumn("last_seen", d)


# N5 -------------------------------------------------------------------------
def drop_test_domains(df: DataFrame, col: str = "domain") -> DataFrame:
    return df.filter(~is_test_domain(F.col(col)))


# N1 -------------------------------------------------------------------------
def normalize_godaddy_domains(docs: DataFrame, as_of) -> DataFrame:
    """Domain pages (JSON arrays) -> domain rows. Empty or missing names are
    dropped, the first occurrence of a name wins (document order, then
    position), test domains are dropped, ``expires`` must be RFC 3339."""
    el = _parsed(_elements(docs))
    el = el.select("_doc", "_pos", "raw_data", _field("domain").alias("domain"),
                   _field("expires").alias("expires"))
    el = el.filter(F.col("domain").isNotNull() & (F.col("domain") != ""))
    el = el.withColumn("_ord", F.struct("_doc", "_pos"))
    first = dedupe_first(el.select("domain", "expires", "raw_data", "_ord"), ["domain"], "_ord")
    first = drop_test_domains(first)
    out = first.select("domain", F.lit(GODADDY).alias("registrar"), F.lit("active").alias("status"),
                       parse_rfc3339_date(F.col("expires")).alias("expiry_date"), "raw_data",
                       F.col("_ord").alias("_ordinal"))
    return _dated(out, as_of)


def of_kept_domains(record_docs: DataFrame, domains: DataFrame) -> DataFrame:
    """Record pages of the domains that N1 keeps: records of test domains and of
    domains that the account does not list are never collected."""
    kept = domains.select(F.col("domain").alias("_kept"))
    return record_docs.join(kept, F.col("domain") == F.col("_kept"), "left_semi")


# N2 -------------------------------------------------------------------------
def normalize_godaddy_records(docs: DataFrame, as_of) -> DataFrame:
    """Record pages of one domain each (``domain`` column + JSON array)."""
    el = _parsed(_elements(docs))
    out = el.select(
        "domain",
        normalize_subdomain(F.coalesce(_field("name"), F.lit(""))).alias("subdomain"),
        normalize_record_type(F.coalesce(_field("type"), F.lit(""))).alias("record_type"),
        F.coalesce(_field("data"), F.lit("")).alias("data"),
        _as_int("ttl").alias("ttl"), _as_int("priority").alias("priority"),
        F.lit(GODADDY).alias("source"), F.lit("active").alias("status"), "raw_data",
        F.struct("_doc", "_pos").alias("_ordinal"))
    return _dated(out, as_of)


# N3 -------------------------------------------------------------------------
ENVELOPE = ("success BOOLEAN, result ARRAY<STRING>, "
            "errors ARRAY<STRUCT<code: INT, message: STRING>>")


def parse_envelopes(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c != "value"]
    return docs.select(*keep, F.from_json(F.col("value"), ENVELOPE).alias("env"))


def envelope_errors(docs: DataFrame) -> DataFrame:
    """Rejected envelopes: ``success`` false, with the first error message."""
    env = parse_envelopes(docs)
    keep = [c for c in docs.columns if c != "value"]
    return env.filter(~F.coalesce(F.col("env.success"), F.lit(False))).select(
        *keep, F.coalesce(F.col("env.errors")[0]["message"], F.lit("unknown")).alias("error"))


def rejected_pages(docs: DataFrame, provider: str) -> DataFrame:
    """Pages that give no rows because they failed: rejected envelopes, and
    pages that are not the JSON the provider sends (``error`` says why)."""
    if provider == CLOUDFLARE:
        return envelope_errors(docs)
    keep = [c for c in docs.columns if c != "value"]
    # the page stays where it landed: a message names it and shows its beginning
    start = F.substring(F.regexp_replace(F.coalesce("value", F.lit("null")), r"\s+", " "), 1, ERROR_CHARS)
    whole = F.char_length(F.coalesce("value", F.lit("null"))) <= ERROR_CHARS
    where = [F.concat(F.lit(" (page "), F.to_json(F.struct("_doc")), F.lit(")"))] if "_doc" in docs.columns else []
    return docs.filter(F.from_json("value", "array<string>").isNull()).select(
        *keep, F.concat(F.lit("not a JSON array: "), start, F.when(whole, F.lit("")).otherwise(F.lit(" ...")), *where).alias("error"))


def _accepted(docs: DataFrame) -> DataFrame:
    env = parse_envelopes(docs)
    keep = [c for c in docs.columns if c != "value"]
    ok = env.filter(F.coalesce(F.col("env.success"), F.lit(False)))
    return ok.select(*keep, F.posexplode_outer("env.result").alias("_pos", "raw_data")).filter(
        F.col("raw_data").isNotNull())


def normalize_cloudflare_zones(docs: DataFrame, as_of) -> DataFrame:
    """Zone envelopes -> zone rows (``zone_id`` kept for the record join)."""
    el = _parsed(_accepted(docs))
    z = el.select(F.coalesce(_field("id"), F.lit("")).alias("zone_id"),
                  F.coalesce(_field("name"), F.lit("")).alias("domain"), "raw_data",
                  F.struct("_doc", "_pos").alias("_ordinal"))
    z = z.filter((F.col("zone_id") != "") & (F.col("domain") != ""))
    z = drop_test_domains(z)
    out = z.select("zone_id", "domain", F.lit(CLOUDFLARE).alias("registrar"),
                   F.lit("active").alias("status"), F.lit(None).cast("date").alias("expiry_date"),
                   "raw_data", "_ordinal")
    return _dated(out, as_of)


# J4 -------------------------------------------------------------------------
def attach_zone(records: DataFrame, zones: DataFrame) -> DataFrame:
    """Inner join of records to their zone by id; the planner broadcasts the
    zone list when its bytes allow."""
    z = zones.select("zone_id", F.col("domain").alias("zone_name"))
    return records.join(z, "zone_id")


# N4 -------------------------------------------------------------------------
def normalize_cloudflare_records(docs: DataFrame, zones: DataFrame, as_of) -> DataFrame:
    """Record envelopes of one zone each (``zone_id`` column) -> record rows,
    host names made relative to the zone."""
    el = _parsed(attach_zone(_accepted(docs), zones))
    out = el.select(
        F.col("zone_name").alias("domain"),
        extract_subdomain(F.coalesce(_field("name"), F.lit("")), F.col("zone_name")).alias("subdomain"),
        normalize_record_type(F.coalesce(_field("type"), F.lit(""))).alias("record_type"),
        F.coalesce(_field("content"), F.lit("")).alias("data"),
        _as_int("ttl").alias("ttl"), _as_int("priority").alias("priority"),
        F.lit(CLOUDFLARE).alias("source"), F.lit("active").alias("status"), "raw_data",
        F.struct("_doc", "_pos").alias("_ordinal"))
    return _dated(out, as_of)


# N8 -------------------------------------------------------------------------
def flag_record_type(df: DataFrame, col: str = "record_type") -> DataFrame:
    return df.withColumn("valid_record_type", is_valid_record_type(F.col(col)))


__all__ = ["normalize_godaddy_domains", "normalize_godaddy_records", "normalize_cloudflare_zones",
           "normalize_cloudflare_records", "envelope_errors", "drop_test_domains", "attach_zone",
           "flag_record_type", "dedupe_first"]

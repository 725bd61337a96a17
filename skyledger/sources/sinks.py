"""Exports (K1-K5, K7): JSON, CSV and metadata, written by the executors.

Ordered exports use a global sort, so part files are in key order without
funnelling rows through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.expr import format_date, js_string
from skyledger.operators.unify import REMOVED_ORDER
from skyledger.operators.views import ViewSpec

DOMAIN_EXPORT = ["domain", "registrar", "status", "expiry_date", "discovery_date", "last_seen"]
DNS_EXPORT = ["domain", "subdomain", "type", "data", "source", "status", "discovery_date", "last_seen"]


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[format_date(f.name).alias(f.name) if isinstance(f.dataType, T.DateType)
                       else F.col(f.name) for f in df.schema.fields])


# K1 -------------------------------------------------------------------------
def domains_export_frame(domains: DataFrame) -> DataFrame:
    # dates become text behind the sort, so that less is shuffled
    return _dates_as_text(domains.select(*DOMAIN_EXPORT).orderBy("domain"))


def export_domains(domains: DataFrame, path: str) -> None:
    """Six fields, every status, ordered by domain; null dates are omitted."""
    domains_export_frame(domains).write.mode("overwrite").json(path)


# K2 -------------------------------------------------------------------------
def dns_export_frame(dns: DataFrame) -> DataFrame:
    d = dns.withColumnRenamed("record_type", "type")
    return _dates_as_text(d.select(*DNS_EXPORT).orderBy("domain", "subdomain"))


def export_dns(dns: DataFrame, path: str) -> None:
    dns_export_frame(dns).write.mode("overwrite").json(path)


# K3 -------------------------------------------------------------------------
def export_removed(removed: DataFrame, path: str) -> None:
    """Removed assets (from ``unify.removed_assets``), domains first."""
    order = [c for c in REMOVED_ORDER if c in removed.columns]
    out = removed.orderBy(*order) if order else removed
    _dates_as_text(out.drop(*order)).write.mode("overwrite").json(path)


# K4 -------------------------------------------------------------------------
def update_metadata(meta: DataFrame, domains: DataFrame, dns: DataFrame, now: str) -> DataFrame:
    """Upsert the ``dns`` provider (schedule daily, per-service counts and
    time ``now``), keep every other provider; flat rows in, flat rows out."""
    from skyledger.operators.merge import combine_rows
    counts = combine_rows([domains.agg(F.count(F.lit(1)).alias("d")), dns.agg(F.count(F.lit(1)).alias("r"))],
                          ["d", "r"])
    now_l = F.lit(now)
    new = counts.select(F.explode(F.array(
        F.struct(F.lit("domains").alias("service"), F.col("d").alias("count")),
        F.struct(F.lit("subdomains").alias("service"), F.col("r").alias("count")))).alias("s")).select(
        F.lit("dns").alias("provider_key"), F.lit("DNS").alias("name"),
        F.lit("GoDaddy/Cloudflare").alias("provider"), F.lit("daily").alias("schedule"),
        now_l.alias("provider_last_updated"), F.col("s.service").alias("service"),
        now_l.alias("last_updated"), F.col("s.count").cast("long").alias("count"))
    keep = meta.filter(~F.col("provider_key").eqNullSafe("dns"))
    return keep.unionByName(new)


def metadata_documents(flat: DataFrame, now: str) -> DataFrame:
    """Flat metadata -> JSON lines in the nesting of the metadata file
    (provider -> services -> service), one document per service entry (a
    provider without services keeps one document with an empty map), so no
    task ever holds a provider's whole service list."""
    svc = F.when(F.col("service").isNotNull(), F.create_map(
        F.col("service"), F.struct("last_updated", "count"))).otherwise(
        F.create_map().cast("map<string,struct<last_updated:string,count:bigint>>"))
    body = F.struct("name", "provider", "schedule", F.col("provider_last_updated").alias("last_updated"),
                    svc.alias("services"))
    return flat.select(F.to_json(F.struct(F.create_map(F.col("provider_key"), body).alias("services"),
                                          F.lit(now).alias("last_updated"))).alias("value"))


def metadata_document(flat: DataFrame, now: str) -> DataFrame:
    """Flat metadata -> the one nested document of the metadata file. For a
    catalog of services (some hundred entries), which becomes one row."""
    entry = F.when(F.col("service").isNotNull(), F.struct("service", F.struct("last_updated", "count").alias("v")))
    heads = ["name", "provider", "schedule", "provider_last_updated"]
    providers = flat.groupBy("provider_key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in heads],
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("services"))
    body = F.struct("name", "provider", "schedule", F.col("provider_last_updated").alias("last_updated"), "services")
    return providers.agg(F.to_json(F.struct(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider_key", body.alias("v"))),
                                        lambda a, b: F.when(a["provider_key"] < b["provider_key"], -1).otherwise(1)))
        .alias("services"), F.lit(now).alias("last_updated"))).alias("value"))


def export_metadata(flat: DataFrame, path: str, now: str, document: bool = False) -> None:
    """Metadata as JSON lines, or with ``document`` as one nested document."""
    (metadata_document if document else metadata_documents)(flat, now).write.mode("overwrite").text(path)


# K5 -------------------------------------------------------------------------
CSV_OPTIONS = {
    "header": "false", "quote": '"', "escape": '"', "nullValue": "", "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n",
}


def csv_frame(df: DataFrame, view: ViewSpec) -> DataFrame:
    """All view columns (hidden ones too) as text under their titles; null
    becomes '', while 0 and false are kept."""
    return df.select(*[F.coalesce(js_string(df, c.data), F.lit("")).alias(c.title) for c in view.columns])


def export_csv(df: DataFrame, view: ViewSpec, path: str) -> None:
    """CSV of the filtered and sorted rows (keep ``df``'s order). The header is
    the only row of the first part file: the parts joined in name order are
    one CSV file with one header."""
    body = csv_frame(df, view)
    titles = df.sparkSession.range(0, 1, 1, 1).select(
        *[F.lit(c.title).alias(f"c{i}") for i, c in enumerate(view.columns)])
    titles.union(body).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


# K7 -------------------------------------------------------------------------
def export_all(domains: DataFrame, dns: DataFrame, meta: DataFrame, out_dir: str, now: str,
               document: bool = False) -> None:
    """Domains, records, removed assets and metadata. Each export reads its own
    columns of the committed snapshots; nothing is cached."""
    from skyledger.operators.unify import removed_assets

    export_domains(domains, f"{out_dir}/domains")
    export_dns(dns, f"{out_dir}/subdomains")
    export_removed(removed_assets(domains, dns), f"{out_dir}/removed")
    export_metadata(update_metadata(meta, domains, dns, now), f"{out_dir}/metadata", now, document)

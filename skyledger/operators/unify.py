"""Heterogeneous services in one result: removed assets (U1-U3, A6) and the
global search (G1, G2, F8, F9, A3, W3).

Each service keeps its own schema; the unified rows are built with
first-truthy chains over whatever fields a service has (resolved against
its schema when the plan is built) and combined with ``unionByName``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions.expr import (first_truthy, fqdn, js_string, record_details,
                                      service_label)
from skyledger.operators.views import (ViewSpec, filter_providers, filter_removed_between,
                                       match_any_string, only_removed, project_view, string_fields)


# U1 -------------------------------------------------------------------------
def removed_assets(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """Removed domains, then removed DNS records, as one removed-asset table
    (bag union; ``_part``/``_order`` keep the published order)."""
    d = domains.filter(F.col("status") == "removed").select(
        F.lit("domain").alias("asset_type"), F.col("domain").alias("name"),
        F.col("registrar").alias("provider"), F.lit("Domain removed from registrar").alias("details"),
        "discovery_date", F.col("last_seen").alias("removed_date"), F.lit("removed").alias("status"),
        F.lit(0).alias("_part"), F.col("domain").alias("_k1"), F.lit("").alias("_k2"))
    r = dns.filter(F.col("status") == "removed").select(
        F.lit("subdomain").alias("asset_type"), fqdn("subdomain", "domain").alias("name"),
        F.col("source").alias("provider"), record_details("record_type", "data").alias("details"),
        "discovery_date", F.col("last_seen").alias("removed_date"), F.lit("removed").alias("status"),
        F.lit(1).alias("_part"), F.col("domain").alias("_k1"), F.col("subdomain").alias("_k2"))
    return d.unionByName(r)


REMOVED_ORDER = ["_part", "_k1", "_k2"]

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Per-provider projection of a removed row: service label rule, name chain,
# and extra columns as (output name, source chain). Every value ends in 'N/A'.
REMOVED_PROJECTIONS = {
    "dns": ("capitalize", "asset_type", ["domain", "subdomain"],
            [("type", ["type", "registrar"]), ("source", ["source", "registrar"])]),
    "azure": ("upper_first_underscore", "service_type", ["name", "display_name"],
              [("account", ["account"]), ("resource_group", ["resource_group"]), ("location", ["location"])]),
    "gcp": ("upper", "service_type", ["name", "email", "dataset_id"],
            [("account", ["account"]), ("project", ["project"])]),
    "cloudflare": ("upper_first_dash", "service_type", ["name", "title", "id"],
                   [("account", ["account", "account_id"])]),
    "digitalocean": ("upper", "service_type", ["name", "spec_name"],
                     [("account", ["account"]), ("region", ["region"])]),
    "oracle": ("upper", "service_type", ["display_name", "db_name", "name"],
               [("account", ["account"]), ("region", ["region"])]),
    "alibaba": ("upper", "service_type",
                ["instance_name", "db_instance_description", "name", "instance_id", "cluster_id"],
                [("account", ["account"]), ("region", ["region_id", "location"])]),
    "aws": ("upper", "service_type", ["name", "id"], [("region", ["region"])]),
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Service:
    """One entry of a service catalog."""
    provider: str
    key: str
    df: DataFrame
    name_field: str | None = None
    page: str = ""
    label: str = ""


# U2 -------------------------------------------------------------------------
def removed_unified(services: list[Service], provider: str, date_from: str | None = None,
                    date_to: str | None = None, last_seen_fallback: bool = True) -> DataFrame:
    """Removed rows of all services of a provider projected to one shape.
    The removed date is ``removed_date``, else (by default) ``last_seen`` -
    the date a merge leaves on a removed row - else 'N/A';
    ``last_seen_fallback=False`` keeps the literal 'N/A' for rows without
    ``removed_date``."""
    rule, label_col, name_chain, extras = REMOVED_PROJECTIONS[provider]
    parts = []
    for s in services:
        df = only_removed(s.df)
        chain = ([s.name_field] if s.name_field and s.name_field not in name_chain else []) + name_chain
        cols: list[Column] = [service_label(F.lit(s.key), rule).alias(label_col),
                              first_truthy(df, chain, "N/A").alias("name")]
        cols += [first_truthy(df, chain_e, "N/A").alias(out) for out, chain_e in extras]
        dates = ["removed_date", "last_seen"] if last_seen_fallback else ["removed_date"]
        cols.append(first_truthy(df, dates, "N/A").alias("removed_date"))
        cols.append(js_string(df, "status").alias("status"))
        parts.append(df.select(*cols))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return filter_removed_between(out, date_from, date_to)


# A1 (dashboard) -------------------------------------------------------------
def status_dashboard(services: list[Service]) -> DataFrame:
    """Total, active and removed rows of every service (one pass each)."""
    out = None
    for s in services:
        st = F.col("status") if "status" in s.df.columns else F.lit(None).cast("string")
        part = s.df.agg(F.count(F.lit(1)).alias("total"), F.count_if(st == "active").alias("active"),
                        F.count_if(st == "removed").alias("removed")).select(
            F.lit(s.provider).alias("provider"), F.lit(s.key).alias("service"), "total", "active", "removed")
        out = part if out is None else out.unionByName(part)
    return out


# U3 -------------------------------------------------------------------------
def removed_service(df: DataFrame, view: ViewSpec, date_from: str | None = None,
                    date_to: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Removed rows of one service in its own column list. The date range
    applies to ``removed_date``, or to ``last_seen`` where a row has none
    (rows of the merge have no ``removed_date``)."""
    removed = only_removed(df)
    dates = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("removed_date", "last_seen") if c in df.columns]
    if dates and (date_from or date_to):
        removed = filter_removed_between(removed.withColumn("_removed_on", F.coalesce(*dates)), date_from, date_to,
                                         "_removed_on").drop("_removed_on")
    return project_view(removed, view, keep)


def removed_services(services: list[Service], views: dict[str, ViewSpec], date_from: str | None = None,
                     date_to: str | None = None) -> DataFrame:
    """Removed rows of all of a provider's services, each in its own column list,
    as one table: the service, its titled cells in column order and its ordinal."""
    out = None
    for s in services:
        view = views[s.key]
        rows = removed_service(s.df, view, date_from, date_to, ["_ordinal"] if "_ordinal" in s.df.columns else None)
        cells = F.array(*[F.struct(F.lit(c.title).alias("title"), js_string(rows, c.data).alias("value")) for c in view.columns])
        ordinal = F.col("_ordinal").cast("long") if "_ordinal" in rows.columns else F.lit(None).cast("long")
        part = rows.select(F.lit(s.provider).alias("provider"), F.lit(s.key).alias("service"), cells.alias("cells"), ordinal.alias("_ordinal"))
        out = part if out is None else out.unionByName(part)
    return out


# G1 -------------------------------------------------------------------------
def search_hits(s: Service, q: str, ordinal: str = "_ordinal") -> DataFrame:
    """Matching rows of one service as hit rows."""
    df = match_any_string(s.df, q)
    chain = ([s.name_field] if s.name_field else []) + ["name", "id"]
    status = js_string(df, "status") if "status" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.lit(s.provider).alias("provider"), F.lit(s.key).alias("service"), F.lit(s.page).alias("page"),
        first_truthy(df, chain, "Unknown").alias("name"),
        first_truthy(df, ["account"], "-").alias("account"),
        first_truthy(df, ["region", "location", "zone"], "").alias("region"),
        F.when(status == "active", F.lit("active")).otherwise(F.lit("removed")).alias("status_class"),
        first_truthy(df, ["status"], "unknown").alias("status_text"),
        (F.col(ordinal) if ordinal in df.columns else F.monotonically_increasing_id()).alias("_ordinal"))


def global_search(catalog: list[Service], q: str, providers=None) -> DataFrame:
    """S2 -> F8 -> F9 -> hit rows, over every service of the catalog."""
    q = (q or "").strip()
    chosen = [s for s in catalog if not providers or "all" in providers or s.provider in providers]
    if not chosen or len(q) < 2:
        return catalog[0].df.sparkSession.createDataFrame(
            [], "provider string, service string, page string, name string, account string, "
                "region string, status_class string, status_text string, _ordinal long")
    out = None
    for s in chosen:
        h = search_hits(s, q)
        out = h if out is None else out.unionByName(h)
    return filter_providers(out, providers)


# G1 at scale: a search index built once ---------------------------------------
def build_search_index(catalog: list[Service], ordinal: str = "_ordinal") -> DataFrame:
    """One row per asset of every service: the hit columns of G1 resolved
    against each service's schema, plus ``_strings`` = the row's top-level
    string values, lower-cased (the only values a search may match). Write it
    partitioned by ``provider`` and searches prune providers and scan one
    narrow table instead of every service file."""
    out = None
    for s in catalog:
        df = s.df
        chain = ([s.name_field] if s.name_field else []) + ["name", "id"]
        status = js_string(df, "status") if "status" in df.columns else F.lit(None).cast("string")
        strings = [F.lower(F.col(f"`{c}`")) for c in string_fields(df)]
        arr = F.filter(F.array(*strings), lambda x: x.isNotNull()) if strings else F.array().cast("array<string>")
        part = df.select(
            F.lit(s.provider).alias("provider"), F.lit(s.key).alias("service"), F.lit(s.page).alias("page"),
            first_truthy(df, chain, "Unknown").alias("name"),
            first_truthy(df, ["account"], "-").alias("account"),
            first_truthy(df, ["region", "location", "zone"], "").alias("region"),
            F.when(status == "active", F.lit("active")).otherwise(F.lit("removed")).alias("status_class"),
            first_truthy(df, ["status"], "unknown").alias("status_text"),
            (F.col(ordinal) if ordinal in df.columns else F.monotonically_increasing_id()).cast("long")
            .alias("_ordinal"),
            arr.alias("_strings"))
        out = part if out is None else out.unionByName(part)
    return out


def search_index(index: DataFrame, q: str, providers=None) -> DataFrame:
    """G1 over a search index: provider pruning, then any string value
    containing the (trimmed, >= 2 characters, case-insensitive) query."""
    q = (q or "").strip()
    if len(q) < 2:
        return index.filter(F.lit(False)).drop("_strings")
    needle = q.lower()
    hits = filter_providers(index, providers).filter(F.exists("_strings", lambda x: x.contains(needle)))
    return hits.drop("_strings")


# G2 -------------------------------------------------------------------------
_JAVA_SPECIAL = re.compile(r"([\\.\[\]{}()*+\-?^$|&])")


def mark_matches(c, q: str, open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """Wrap every case-insensitive occurrence of the literal query."""
    c = F.col(c) if isinstance(c, str) else c
    if not q:
        return c
    pattern = "(?iu)(" + _JAVA_SPECIAL.sub(r"\\\1", q) + ")"
    repl = open_tag.replace("$", "\\$") + "$1" + close_tag.replace("$", "\\$")
    return F.regexp_replace(c, pattern, repl)


# A3 -------------------------------------------------------------------------
def search_counts(hits: DataFrame) -> DataFrame:
    """Hits per (provider, service)."""
    return hits.groupBy("provider", "service").agg(F.count(F.lit(1)).alias("hits"))


def search_rollup(hits: DataFrame) -> DataFrame:
    """Hits per service, per provider and in total in one aggregation
    (``rollup``): ``level`` is 'service', 'provider' or 'total'."""
    g = hits.rollup("provider", "service").agg(F.count(F.lit(1)).alias("hits"),
                                               F.grouping_id().alias("_gid"))
    return g.select("provider", "service", "hits",
                    F.when(F.col("_gid") == 0, F.lit("service")).when(F.col("_gid") == 1, F.lit("provider"))
                    .otherwise(F.lit("total")).alias("level"))


def search_totals(hits: DataFrame) -> DataFrame:
    """Grand total, providers hit and services hit (one row)."""
    return hits.agg(F.count(F.lit(1)).alias("total_hits"),
                    F.count_distinct("provider").alias("providers_hit"),
                    F.count_distinct("provider", "service").alias("services_hit"))


# W3 -------------------------------------------------------------------------
def top_hits(hits: DataFrame, n: int = 10, ordinal: str = "_ordinal") -> DataFrame:
    """First ``n`` hits per service in source order, with the service's full
    hit count beside. ``row_number() <= n`` alone lets Spark cut each group
    to ``n`` rows before the shuffle; the counts come from a partial
    aggregation, so a service holding most hits never lands whole in one task."""
    w = Window.partitionBy("provider", "service").orderBy(F.col(ordinal))
    first = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    counts = search_counts(hits)
    return first.join(counts, ["provider", "service"])

"""Table views: filters, projections, smart sort, paging, counts.

A view is a plain ``ViewSpec`` (ordered columns with titles and optional
render expressions). Applying it is one Catalyst plan:
not-removed -> account -> row search -> column filters -> sort -> page ->
projection; a page ends in ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.expr import (cell_text, field_type, js_string, num_prefix, path,
                                      sort_text, truthy)

ALLOWED_PAGE_SIZES = (50, 100, 250, 500, -1)


@dataclass(frozen=True)
class ViewColumn:
    title: str
    data: str
    render: Callable[[DataFrame, str], Column] | None = None


@dataclass(frozen=True)
class ViewSpec:
    name: str
    columns: tuple[ViewColumn, ...]
    source: str | None = None
    hidden: frozenset = field(default_factory=frozenset)

    @staticmethod
    def of(name: str, fields: str, source: str | None = None, titles: dict | None = None,
           renders: dict | None = None) -> "ViewSpec":
        """Build a view from a space separated field list."""
        titles = titles or {}
        renders = renders or {}
        cols = tuple(ViewColumn(titles.get(f, f.replace("_", " ").title()), f, renders.get(f))
                     for f in fields.split())
        return ViewSpec(name, cols, source)

    @property
    def fields(self) -> list[str]:
        return [c.data for c in self.columns]


def out_name(data: str) -> str:
    return data.replace(".", "_")


# F1 / F2 --------------------------------------------------------------------
def not_removed(df: DataFrame) -> DataFrame:
    """Drop rows whose status is 'removed'; null or absent status stays."""
    if "status" not in df.columns:
        return df
    return df.filter(~F.col("status").eqNullSafe("removed"))


def only_removed(df: DataFrame) -> DataFrame:
    if "status" not in df.columns:
        return df.limit(0)
    return df.filter(F.col("status") == "removed")


# F3 -------------------------------------------------------------------------
def get_domains(df: DataFrame, status: str = "", source: str = "") -> DataFrame:
    """Domains filtered by optional status/registrar, ordered by domain."""
    if status:
        df = df.filter(F.col("status") == status)
    if source:
        df = df.filter(F.col("registrar") == source)
    return df.select("domain", "registrar", "status", "expiry_date", "discovery_date",
                     "last_seen").orderBy("domain")


def get_dns_records(df: DataFrame, status: str = "", source: str = "", domain: str = "") -> DataFrame:
    """DNS records filtered by optional status/source/domain, ordered by
    (domain, subdomain); ``record_type`` is published as ``type``."""
    if status:
        df = df.filter(F.col("status") == status)
    if source:
        df = df.filter(F.col("source") == source)
    if domain:
        df = df.filter(F.col("domain") == domain)
    return df.select("domain", "subdomain", F.col("record_type").alias("type"), "data", "source",
                     "status", "discovery_date", "last_seen").orderBy("domain", "subdomain")


# F4 -------------------------------------------------------------------------
def filter_account(df: DataFrame, account: str | None) -> DataFrame:
    """Exact, case-sensitive account match; no account -> no filter."""
    if not account:
        return df
    if "account" not in df.columns:
        return df.limit(0)
    return df.filter(F.col("account") == account)


def _view_of(df: DataFrame, view: ViewSpec | None) -> list[str]:
    return view.fields if view is not None else df.columns


# F5 -------------------------------------------------------------------------
def filter_columns(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Per-column case-insensitive substring, AND over columns; falsy = ''."""
    for name, text in (filters or {}).items():
        if not text:
            continue
        df = df.filter(F.lower(cell_text(df, name)).contains(text.lower()))
    return df


# F6 -------------------------------------------------------------------------
def row_text(df: DataFrame, view: ViewSpec | None = None) -> Column:
    """All view columns (hidden ones too) as cell text joined by one space."""
    return F.lower(F.concat_ws(" ", *[cell_text(df, n) for n in _view_of(df, view)]))


def search_rows(df: DataFrame, text: str | None, view: ViewSpec | None = None) -> DataFrame:
    """Row search; a match may span two adjacent cells."""
    if not text:
        return df
    return df.filter(row_text(df, view).contains(text.lower()))


# F7 -------------------------------------------------------------------------
def filter_removed_between(df: DataFrame, date_from: str | None, date_to: str | None,
                           col: str = "removed_date") -> DataFrame:
    """Both ends inclusive; missing, 'N/A' or unparseable dates always pass."""
    if not date_from and not date_to:
        return df
    dtype = field_type(df, col)
    if dtype is None:
        return df
    c = F.col(col)
    ts = c.cast("timestamp") if not isinstance(dtype, T.StringType) else F.try_to_timestamp(c)
    cond = F.lit(True)
    if date_from:
        cond = cond & (ts >= F.lit(date_from).cast("timestamp"))
    if date_to:
        cond = cond & (ts <= F.lit(date_to).cast("timestamp"))
    return df.filter(ts.isNull() | cond)


# F8 -------------------------------------------------------------------------
def filter_providers(df: DataFrame, providers, col: str = "provider") -> DataFrame:
    """Keep the listed providers; empty or containing 'all' = no filter."""
    providers = list(providers or [])
    if not providers or "all" in providers:
        return df
    return df.filter(F.col(col).isin(providers))


# F9 -------------------------------------------------------------------------
def string_fields(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def match_any_string(df: DataFrame, q: str | None, exclude=()) -> DataFrame:
    """Rows where any top-level *string* field contains ``q`` (trimmed, at
    least 2 characters, case-insensitive); numbers, booleans, arrays and
    nested objects never match."""
    q = (q or "").strip()
    if len(q) < 2:
        return df.filter(F.lit(False))
    needle = q.lower()
    cols = string_fields(df, exclude)
    if not cols:
        return df.filter(F.lit(False))
    cond = None
    for c in cols:
        term = F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
        cond = term if cond is None else (cond | term)
    return df.filter(cond)


# P1 / P2 / P3 ----------------------------------------------------------------
def project_view(df: DataFrame, view: ViewSpec, keep: list[str] | None = None,
                 rendered: bool = True) -> DataFrame:
    """Ordered view fields; absent fields become null; renders applied."""
    cols = [F.col(k) for k in (keep or [])]
    for vc in view.columns:
        if rendered and vc.render is not None:
            c = vc.render(df, vc.data)
        else:
            c = path(df, vc.data)
        cols.append(c.alias(out_name(vc.data)))
    return df.select(*cols)


def hide_columns(df: DataFrame, view: ViewSpec, hidden_idx) -> DataFrame:
    """Project the view without the hidden column positions."""
    keep = [vc for i, vc in enumerate(view.columns) if i not in set(hidden_idx)]
    return project_view(df, ViewSpec(view.name, tuple(keep), view.source))


# O1 -------------------------------------------------------------------------
def smart_sort_keys(df: DataFrame, name: str) -> tuple[Column, Column, Column]:
    """(bucket, number, text) of the view's comparator made a total order:
    bucket 0 = no number and text below '0' (also ''), 1 = number, 2 = other."""
    t = sort_text(df, name)
    num = num_prefix(t)
    bucket = F.when(num.isNotNull(), F.lit(1)).when(t < F.lit("0"), F.lit(0)).otherwise(F.lit(2))
    return bucket, num, t


def smart_order(df: DataFrame, name: str, direction: str = "asc", ordinal: str = "_ordinal",
                full_text_ties: bool = False) -> list[Column]:
    bucket, num, t = smart_sort_keys(df, name)
    n1 = F.when(bucket == 1, num)
    txt = F.when(bucket != 1, t)
    keys = [bucket, n1, txt]
    if full_text_ties:
        keys.append(t)
    if direction == "desc":
        keys = [k.desc_nulls_last() for k in keys]
    else:
        keys = [k.asc_nulls_first() for k in keys]
    if ordinal in df.columns:
        keys.append(F.col(ordinal).asc())
    return keys


def smart_sort(df: DataFrame, name: str, direction: str = "asc", ordinal: str = "_ordinal",
               full_text_ties: bool = False) -> DataFrame:
    """Sort by one view column; ties keep input order (``ordinal``)."""
    return df.orderBy(*smart_order(df, name, direction, ordinal, full_text_ties))


# O3 / O4 ---------------------------------------------------------------------
def page(df: DataFrame, page_no: int, rows: int, order: list[Column] | None = None,
         position: str | None = None) -> DataFrame:
    """Rows [page*rows, page*rows + rows) of the ordered frame; rows=-1 = all.
    With ``position`` each row carries its 1-based place in the full order
    (computed on the page only, so no global window is needed)."""
    ordered = df.orderBy(*order) if order else df
    if rows == -1:
        return ordered
    start = page_no * rows
    out = ordered.offset(start).limit(rows) if start else ordered.limit(rows)
    if position and order:
        # the page holds at most ``rows`` rows; numbering them is a tiny window
        out = out.withColumn(position, (F.row_number().over(Window.orderBy(*order)) + F.lit(start)).cast("long"))
    return out


def page_after(df: DataFrame, order_cols: list[str], last: tuple | None, rows: int) -> DataFrame:
    """Keyset page for deep paging: rows strictly after ``last`` in the
    ascending order of ``order_cols`` (non-null keys), pushed down as a
    filter instead of an offset."""
    if last is not None:
        cond = None
        for i in range(len(order_cols) - 1, -1, -1):
            c = F.col(order_cols[i]) > F.lit(last[i])
            if cond is not None:
                c = c | ((F.col(order_cols[i]) == F.lit(last[i])) & cond)
            cond = c
        df = df.filter(cond)
    return df.orderBy(*order_cols).limit(rows)


def page_summary(df: DataFrame, page_no: int, rows: int) -> DataFrame:
    """from, to, total and page count of one page (one row)."""
    total = F.count(F.lit(1))
    per = total if rows == -1 else F.lit(rows)
    start = F.lit(0) if rows == -1 else F.lit(page_no * rows)
    return df.agg(total.alias("total")).select(
        F.when(F.col("total") > 0, start + 1).otherwise(F.lit(0)).cast("long").alias("from_row"),
        F.least(start + (F.col("total") if rows == -1 else F.lit(rows)), F.col("total"))
        .cast("long").alias("to_row"),
        F.col("total").cast("long").alias("total"),
        (F.lit(1) if rows == -1 else F.greatest(F.ceil(F.col("total") / F.lit(rows)), F.lit(1)))
        .cast("long").alias("pages"))


# A1 / A2 / A6 ---------------------------------------------------------------
def status_stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, active and removed rows (over the unfiltered table), one pass."""
    aggs = [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "active").alias("active"),
            F.count_if(F.col("status") == "removed").alias("removed")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def accounts(df: DataFrame) -> DataFrame:
    """Distinct truthy accounts, sorted."""
    if "account" not in df.columns:
        return df.sparkSession.createDataFrame([], "account string")
    return (df.filter(truthy(df, "account")).select(js_string(df, "account").alias("account"))
            .distinct().orderBy("account"))


def removed_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


# E2 -------------------------------------------------------------------------
def table_view(df: DataFrame, view: ViewSpec, account: str | None = None,
               search: str | None = None, column_filters: dict | None = None,
               sort_col: int | None = 0, direction: str = "asc", page_no: int = 0,
               rows: int = 50, ordinal: str = "_ordinal", hidden=()) -> DataFrame:
    """One page of a view: F1 -> F4 -> F6 -> F5 -> O1 -> O3 -> P1 (P2: the
    ``hidden`` column positions are still searched but not projected)."""
    if rows not in ALLOWED_PAGE_SIZES:
        raise ValueError(f"rows must be one of {ALLOWED_PAGE_SIZES}")
    df = not_removed(df)
    df = filter_account(df, account)
    df = search_rows(df, search, view)
    df = filter_columns(df, {view.columns[int(k)].data if str(k).isdigit() else k: v
                             for k, v in (column_filters or {}).items()})
    order = smart_order(df, view.columns[sort_col or 0].data, direction, ordinal)
    keep = [ordinal] if ordinal in df.columns else []
    shown = view if not hidden else ViewSpec(view.name, tuple(c for i, c in enumerate(view.columns)
                                                              if i not in set(hidden)), view.source)
    return project_view(page(df, page_no, rows, order), shown, keep)

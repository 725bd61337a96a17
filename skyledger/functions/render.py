"""Cell renderers of the table views (P4-P12) as Column expressions.

Each takes the frame (for the field's type) and a field name and yields the
text a view shows; they are ordinary select expressions, evaluated in
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.expr import field_type, js_string, path, truthy

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Provider short codes shown next to a provider name:
PROVIDER_CODES = {"aws": "AWS", "azure": "AZ", "gcp": "GCP", "godaddy": "GD", "cloudflare": "CF"}
# Badge class of a machine/alarm state: (value -> class, class otherwise)
EC2_STATE_CLASS = ({"running": "running", "stopped": "stopped"}, "terminated")
AZURE_POWER_CLASS = ({"running": "running", "stopped": "stopped"}, "terminated")
GCP_POWER_CLASS = ({"RUNNING": "running", "TERMINATED": "stopped"}, "terminated")
ALARM_STATE_CLASS = ({"OK": "active", "ALARM": "removed"}, "stopped")
# ---------------------------------------------------------------------------


def or_default(df: DataFrame, name: str, text: str) -> Column:
    """``val || text``."""
    return F.when(truthy(df, name), js_string(df, name)).otherwise(F.lit(text))


def bool_label(df: DataFrame, name: str, yes: str = "Yes", no: str = "No") -> Column:
    """P5: ``val ? yes : no``."""
    return F.when(truthy(df, name), F.lit(yes)).otherwise(F.lit(no))


def list_label(df: DataFrame, name: str, empty_as_dash: bool = True) -> Column:
    """``val && val.length ? val.join(', ') : '-'`` (or ``val ? ... : '-'``)."""
    dtype = field_type(df, name)
    if not isinstance(dtype, T.ArrayType):
        return F.when(truthy(df, name), js_string(df, name)).otherwise(F.lit("-"))
    c = path(df, name)
    joined = F.array_join(c.cast("array<string>"), ", ", "")
    present = c.isNotNull() & (F.size(c) > 0) if empty_as_dash else c.isNotNull()
    return F.when(present, joined).otherwise(F.lit("-"))


def state_class(df: DataFrame, name: str, mapping: tuple[dict, str]) -> Column:
    """Map a provider state to a badge class, else the default class."""
    table, default = mapping
    c = path(df, name)
    out = None
    for value, cls in table.items():
        out = F.when(c == value, F.lit(cls)) if out is None else out.when(c == value, F.lit(cls))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def badge_type(df: DataFrame, name: str, explicit: Column | None = None) -> Column:
    """Explicit type, else the lower-cased value."""
    low = F.lower(js_string(df, name))
    return F.coalesce(explicit, low) if explicit is not None else low


def with_unit(df: DataFrame, name: str, unit: str, otherwise: str) -> Column:
    """``val ? `${val}unit` : otherwise``."""
    return (F.when(truthy(df, name), F.concat(js_string(df, name), F.lit(unit)))
            .otherwise(F.lit(otherwise)))


def tags_text(df: DataFrame, name: str) -> Column:
    """P10: each entry as ``key: value``; null or non-object gives ''."""
    dtype = field_type(df, name)
    if isinstance(dtype, T.MapType):
        c = path(df, name)
        entries = F.transform(F.map_entries(c), lambda e: F.concat(
            e["key"].cast("string"), F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit(""))))
        return F.coalesce(F.array_join(entries, " "), F.lit(""))
    if isinstance(dtype, T.StructType):
        c = path(df, name)
        parts = [F.concat(F.lit(f.name + ": "), F.coalesce(c.getField(f.name).cast("string"), F.lit("")))
                 for f in dtype.fields]
        return F.when(c.isNotNull(), F.concat_ws(" ", *parts)).otherwise(F.lit(""))
    return F.lit("")


def explode_tags(df: DataFrame, name: str = "tags") -> DataFrame:
    """P10 (tag-level analysis): one row per tag entry."""
    return df.select("*", F.explode_outer(F.col(name)).alias("tag_key", "tag_value"))


def provider_code(c) -> Column:
    """Short provider code, case-insensitive; unknown names pass through."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[F.lit(x) for kv in PROVIDER_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(c)), c)


def row_class(df: DataFrame) -> Column:
    """``removed`` for removed rows, else ''."""
    if "status" not in df.columns:
        return F.lit("")
    return F.when(F.col("status") == "removed", F.lit("removed")).otherwise(F.lit(""))

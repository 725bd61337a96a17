"""Scalar expressions (Column -> Column), all JVM-side built-ins.

Naming follows the semantics they reproduce: Go string helpers of the
collectors (test domains, subdomain rules) and JavaScript coercions of the
table views (truthiness, ``String(v)``, ``parseFloat``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Exact names treated as test/example domains:
TEST_DOMAIN_NAMES = [
    "example.com", "example.org", "example.net",
    "test.com", "test.org", "test.net",
    "domain.com", "domain.org", "domain.net",
    "localhost", "invalid", "example", "test", "local", "internal", "localdomain",
]
# Prefixes that mark a test domain:
TEST_DOMAIN_PREFIXES = [
    "test-", "test.", "example-", "example.", "demo-", "demo.", "staging-", "dev-",
]
# DNS record types accepted as valid:
VALID_RECORD_TYPES = [
    "A", "AAAA", "CNAME", "MX", "TXT", "NS", "SOA", "SRV", "CAA", "PTR",
    "NAPTR", "DNSKEY", "DS", "TLSA", "SSHFP", "SPF",
]
# ---------------------------------------------------------------------------

_UNICODE_TRIM = r"(?U)^\s+|\s+$"
_NUM_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# X12 -----------------------------------------------------------------------
def trim_unicode(c) -> Column:
    """Strip leading/trailing Unicode white space (tabs, newlines, NBSP ...)."""
    return F.regexp_replace(_c(c), _UNICODE_TRIM, "")


# X1 ------------------------------------------------------------------------
def is_test_domain(c) -> Column:
    d = F.lower(trim_unicode(c))
    cond = d.isin(TEST_DOMAIN_NAMES)
    for p in TEST_DOMAIN_PREFIXES:
        cond = cond | d.startswith(p)
    return F.coalesce(cond, F.lit(False))


# X2 ------------------------------------------------------------------------
def normalize_subdomain(c) -> Column:
    s = trim_unicode(c)
    return F.when(s == "@", F.lit("")).otherwise(F.lower(s))


def _strip_one_dot(s: Column) -> Column:
    return F.when(s.endswith("."), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(s)


# X3 ------------------------------------------------------------------------
def extract_subdomain(host, domain) -> Column:
    """Host relative to its zone: '' at the apex, the label prefix below it,
    the host itself when it lies outside the zone."""
    h = _strip_one_dot(F.lower(trim_unicode(host)))
    d = _strip_one_dot(F.lower(trim_unicode(domain)))
    suffix = F.concat(F.lit("."), d)
    return (F.when(h == d, F.lit(""))
            .when(h.endswith(suffix), F.substring(h, F.lit(1), F.length(h) - F.length(d) - 1))
            .otherwise(h))


# X4 ------------------------------------------------------------------------
def normalize_record_type(c) -> Column:
    return F.upper(trim_unicode(c))


def is_valid_record_type(c) -> Column:
    return F.upper(_c(c)).isin(VALID_RECORD_TYPES)


# X5 ------------------------------------------------------------------------
def fqdn(subdomain, domain) -> Column:
    s, d = _c(subdomain), _c(domain)
    return F.when(s.isNull() | (s == ""), d).otherwise(F.concat(s, F.lit("."), d))


# X6 ------------------------------------------------------------------------
def record_details(record_type, data) -> Column:
    return F.format_string("%s record - %s", _c(record_type), _c(data))


# X7 ------------------------------------------------------------------------
def format_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


# X8 ------------------------------------------------------------------------
def service_label(key, rule: str) -> Column:
    """Label of a service key: ``capitalize`` (first letter upper), ``upper``,
    ``upper_first_underscore`` / ``upper_first_dash`` (upper case, first
    separator replaced by a space)."""
    k = _c(key)
    if rule == "capitalize":
        return F.concat(F.upper(F.substring(k, 1, 1)), F.substring(k, 2, 1 << 30))
    if rule == "upper":
        return F.upper(k)
    if rule == "upper_first_underscore":
        return F.regexp_replace(F.upper(k), r"^([^_]*)_", "$1 ")
    if rule == "upper_first_dash":
        return F.regexp_replace(F.upper(k), r"^([^-]*)-", "$1 ")
    raise ValueError(f"unknown label rule {rule}")


# JavaScript coercions, dispatched on the Spark type ---------------
def field_type(df: DataFrame, name: str) -> T.DataType | None:
    """Type of a (possibly dotted) field, or None when absent."""
    dtype: T.DataType = df.schema
    for part in name.split("."):
        if isinstance(dtype, T.StructType) and part in dtype.fieldNames():
            dtype = dtype[part].dataType
        elif isinstance(dtype, T.MapType):
            dtype = dtype.valueType
        else:
            return None
    return dtype


# The name-based helpers below render one SQL expression per call (a single
# JVM round trip when the plan is built).
def _ident(part: str) -> str:
    return "`" + part.replace("`", "``") + "`"


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_path(df: DataFrame, name: str) -> tuple[str, T.DataType] | None:
    dtype: T.DataType = df.schema
    sql = None
    for part in name.split("."):
        if isinstance(dtype, T.StructType) and part in dtype.fieldNames():
            sql = _ident(part) if sql is None else f"{sql}.{_ident(part)}"
            dtype = dtype[part].dataType
        elif isinstance(dtype, T.MapType) and sql is not None:
            sql = f"try_element_at({sql}, {_quote(part)})"
            dtype = dtype.valueType
        else:
            return None
    return sql, dtype


def _truthy_sql(p: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.NullType):
        return "false"
    if isinstance(dtype, T.StringType):
        return f"coalesce({p} <> '', false)"
    if isinstance(dtype, T.BooleanType):
        return f"coalesce({p}, false)"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"coalesce({p} <> 0 AND NOT isnan({p}), false)"
    if isinstance(dtype, T.NumericType):
        return f"coalesce({p} <> 0, false)"
    return f"({p} IS NOT NULL)"


def _js_sql(p: str, dtype: T.DataType, depth: int = 0) -> str:
    if isinstance(dtype, T.StringType):
        return p
    if isinstance(dtype, T.NullType):
        return "CAST(NULL AS STRING)"
    if isinstance(dtype, T.BooleanType):
        return f"CASE WHEN {p} THEN 'true' WHEN NOT {p} THEN 'false' END"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # plain digits from 1e-6 up to 1e21, as JavaScript writes them
        text = f"CAST({p} AS STRING)"
        plain = "rtrim('0', CAST(CAST({0} AS DECIMAL(38,{1})) AS STRING))"
        power = f"regexp_replace(regexp_replace({text}, '[.]0E|E', 'e'), 'e([0-9])', 'e+$1')"
        return (f"CASE WHEN {p} = rint({p}) AND abs({p}) < 1e21 THEN CAST(CAST({p} AS DECIMAL(38,0)) AS STRING) "
                f"WHEN abs({p}) >= 1 AND abs({p}) < 1e21 THEN {plain.format(text, 17)} "
                f"WHEN abs({p}) >= 1e-6 AND abs({p}) < 1 THEN {plain.format(text, 24)} "
                f"WHEN isnan({p}) OR abs({p}) = double('Infinity') THEN {text} ELSE {power} END")
    if isinstance(dtype, T.NumericType):
        return f"CAST({p} AS STRING)"
    if isinstance(dtype, T.DateType):
        return f"date_format({p}, 'yyyy-MM-dd')"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"concat(date_format({p}, 'yyyy-MM-dd'), 'T', date_format({p}, 'HH:mm:ss'))"
    if isinstance(dtype, T.ArrayType):
        x = f"x{depth}"
        return f"array_join(transform({p}, {x} -> {_js_sql(x, dtype.elementType, depth + 1)}), ',', '')"
    return f"CASE WHEN {p} IS NOT NULL THEN '[object Object]' END"


def path(df: DataFrame, name: str) -> Column:
    """Null-safe nested path ``a.b.c``; absent paths give null."""
    r = _sql_path(df, name)
    return F.expr(r[0]) if r else F.lit(None).cast("string")


def truthy(df: DataFrame, name: str) -> Column:
    r = _sql_path(df, name)
    return F.expr(_truthy_sql(*r)) if r else F.lit(False)


def js_string(df: DataFrame, name: str) -> Column:
    r = _sql_path(df, name)
    return F.expr(_js_sql(*r)) if r else F.lit(None).cast("string")


def cell_text(df: DataFrame, name: str) -> Column:
    """``String(v || '')`` - falsy cells become ''."""
    r = _sql_path(df, name)
    if not r:
        return F.lit("")
    return F.expr(f"CASE WHEN {_truthy_sql(*r)} THEN {_js_sql(*r)} ELSE '' END")


def sort_text(df: DataFrame, name: str) -> Column:
    """``String(v == null ? '' : v).toLowerCase()`` used by the smart sort."""
    r = _sql_path(df, name)
    return F.expr(f"lower(coalesce({_js_sql(*r)}, ''))") if r else F.lit("")


# X10 -----------------------------------------------------------------------
def first_truthy(df: DataFrame, names: list[str], default=None) -> Column:
    """``a || b || ... || default`` as text."""
    parts = []
    for n in names:
        r = _sql_path(df, n)
        if r:
            parts.append(f"CASE WHEN {_truthy_sql(*r)} THEN {_js_sql(*r)} END")
    if default is not None:
        parts.append(_quote(str(default)))
    if not parts:
        return F.lit(None).cast("string")
    return F.expr(parts[0] if len(parts) == 1 else f"coalesce({', '.join(parts)})")


# X11 -----------------------------------------------------------------------
def parse_rfc3339_date(c) -> Column:
    """RFC 3339 timestamp text -> the calendar date as written; bad -> null."""
    c = _c(c)
    ok = c.rlike(_RFC3339) & F.try_to_timestamp(c).isNotNull()
    return F.when(ok, F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))))


# X13 -----------------------------------------------------------------------
def num_prefix(c) -> Column:
    """JS ``parseFloat``: the longest leading decimal number, else null."""
    m = F.regexp_extract(_c(c), _NUM_PREFIX, 1)
    return F.when(m != "", m.try_cast("double"))


# X15 -----------------------------------------------------------------------
def raw_json(*cols) -> Column:
    """Whole source object as JSON text."""
    if not cols:
        return F.to_json(F.struct(F.col("*")))
    return F.to_json(F.struct(*cols))

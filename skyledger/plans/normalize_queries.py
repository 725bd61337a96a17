"""Registered normalisation queries (N1-N8, J4, X1-X15) and SQL twins.

Landed responses are built from the benchmark tables as the providers would
send them: GoDaddy domain pages (<= 50 domains each) and record pages
(<= 100 records each) from ``pages`` host names; Cloudflare zone envelopes
from ``supplier`` and record envelopes (one zone, <= 100 records each) from
``customer``. Every page is a bounded group, and the normalisers only ever
see the JSON text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import expr as E
from skyledger.operators import normalize as N
from skyledger.plans import fixtures as X

AS_OF = "2024-02-01"
HOST_RE = r"^[a-zA-Z]+://([^/?#:]+)"
D3_RE = r"([^.]+\.[^.]+\.[^.]+)$"


def host_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = X.table(spark, sf, "pages")
    k = F.col("page_id")
    host = F.lower(F.regexp_extract("url", HOST_RE, 1))
    d3 = F.regexp_extract(host, D3_RE, 1)
    raw = (F.when(k % 5 == 0, F.concat(F.lit("test-"), d3)).when(k % 5 == 1, F.concat(F.lit("Demo."), d3))
           .when(k % 5 == 2, F.concat(F.lit(" "), F.upper(d3), F.lit("\t"))).when(k % 5 == 3, d3)
           .otherwise(F.lit("example.com")))
    expires = (F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit("not-a-date"))
               .otherwise(F.format_string("2026-%02d-%02dT10:00:00-07:00", k % 12 + 1, k % 28 + 1)))
    rname = (F.when(k % 4 == 0, F.lit("@")).when(k % 4 == 1, F.lit(" WWW "))
             .when(k % 4 == 2, F.lit("\tmail\n")).otherwise(F.split(host, r"\.").getItem(0)))
    rtype = (F.when(k % 7 == 0, F.lit("bogus")).when(k % 3 == 0, F.lit(" a ")).when(k % 3 == 1, F.lit("cname"))
             .otherwise(F.lit("TXT ")))
    return p.select(k.alias("page_id"), "url", host.alias("host"), d3.alias("d3"), raw.alias("domain"),
                    expires.alias("expires"), rname.alias("rname"), rtype.alias("rtype"),
                    (k * F.lit(1.5)).alias("ttl"), F.when(k % 2 == 0, k % 10).alias("priority"))


def _doc(order_col, fields):
    """Aggregate building one JSON array document per group (a bounded page),
    elements in ``order_col`` order."""
    item = F.struct(F.col(order_col).alias("o"), F.struct(*fields).alias("e"))
    return F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"]))


def godaddy_domain_docs(spark, sf, where: str = "true") -> DataFrame:
    h = host_rows(spark, sf).filter(where)
    js = _doc("page_id", ["domain", "expires"])
    return (h.groupBy((F.col("page_id") / 50).cast("long").alias("_doc"))
            .agg(js.alias("value")))


def godaddy_record_docs(spark, sf, where: str = "true") -> DataFrame:
    h = host_rows(spark, sf).filter(F.col("d3") != "").filter(where)
    js = _doc("page_id", [F.col("rname").alias("name"), F.col("rtype").alias("type"),
                          F.col("url").alias("data"), "ttl", "priority"])
    return (h.groupBy(F.col("d3").alias("domain"), (F.col("page_id") / 100).cast("long").alias("_doc"))
            .agg(js.alias("value")))


def _zname(key):
    return F.concat(F.lit("supplier-"), F.lpad(key.cast("string"), 9, "0"), F.lit(".io"))


def cloudflare_zone_docs(spark, sf) -> DataFrame:
    s = X.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    zid = F.when(k % 9 == 4, F.lit("")).otherwise(F.concat(F.lit("z"), k.cast("string")))
    zname = (F.when(k % 6 == 0, F.lit("example.org")).when(k % 6 == 1, F.concat(F.lit("dev-"), _zname(k)))
             .when(k % 6 == 2, F.lit("")).otherwise(_zname(k)))
    s = s.select(k.alias("k"), zid.alias("id"), zname.alias("name"), (k / 20).cast("long").alias("_doc"))
    item = F.struct(F.col("k").alias("o"), F.struct("id", "name").alias("e"))
    result = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"])
    return s.groupBy("_doc").agg(F.to_json(F.struct(
        (F.col("_doc") % 7 != 3).alias("success"), result.alias("result"),
        F.array(F.struct(F.lit(1000).alias("code"), F.lit("bad token").alias("message"))).alias("errors")))
        .alias("value"))


def cloudflare_record_docs(spark, sf) -> DataFrame:
    c = X.table(spark, sf, "customer")
    k = F.col("c_custkey")
    zk = k % 100
    zname = _zname(zk)
    host = (F.when(k % 4 == 0, zname).when(k % 4 == 1, F.concat(F.lit("www."), zname, F.lit(".")))
            .when(k % 4 == 2, F.concat(F.lit("API."), F.upper(zname))).otherwise(F.lit("other.net")))
    rtype = F.when(k % 3 == 0, F.lit("a")).when(k % 3 == 1, F.lit(" mx")).otherwise(F.lit("Txt"))
    c = c.select(k.alias("k"), F.concat(F.lit("z"), zk.cast("string")).alias("zone_id"),
                 (k / 10000).cast("long").alias("_doc"), host.alias("name"), rtype.alias("type"),
                 F.col("c_name").alias("content"),
                 F.when(k % 2 == 1, F.lit(1)).otherwise(F.lit(300)).alias("ttl"),
                 F.when(k % 3 == 1, F.lit(10)).alias("priority"), (zk % 10 != 7).alias("ok"))
    item = F.struct(F.col("k").alias("o"), F.struct("name", "type", "content", "ttl", "priority").alias("e"))
    result = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["e"])
    return c.groupBy("zone_id", "_doc").agg(F.to_json(F.struct(
        F.first("ok").alias("success"), result.alias("result"),
        F.array(F.struct(F.lit(9109).alias("code"), F.lit("zone fetch failed").alias("message")))
        .alias("errors"))).alias("value"))


def zones(spark, sf):
    return N.normalize_cloudflare_zones(cloudflare_zone_docs(spark, sf), AS_OF)


def _fin(df, drop=("raw_data", "_ordinal")):
    return X.finalize(df.drop(*drop))


QUERIES = {
    "n1_godaddy_domains": lambda s, sf: _fin(N.normalize_godaddy_domains(godaddy_domain_docs(s, sf), AS_OF),
                                             ("_ordinal",)),
    "n2_godaddy_records": lambda s, sf: _fin(N.normalize_godaddy_records(godaddy_record_docs(s, sf), AS_OF)),
    "n2_kept_domains": lambda s, sf: _fin(N.normalize_godaddy_records(N.of_kept_domains(
        godaddy_record_docs(s, sf), N.normalize_godaddy_domains(godaddy_domain_docs(s, sf), AS_OF)), AS_OF)),
    "n3_cloudflare_zones": lambda s, sf: _fin(zones(s, sf)),
    "n3_cloudflare_errors": lambda s, sf: N.envelope_errors(cloudflare_zone_docs(s, sf)),
    "n4_cloudflare_records": lambda s, sf: _fin(N.normalize_cloudflare_records(
        cloudflare_record_docs(s, sf), zones(s, sf), AS_OF)),
    "j4_attach_zone": lambda s, sf: N.attach_zone(N._accepted(cloudflare_record_docs(s, sf)), zones(s, sf))
    .groupBy("zone_id", "zone_name").agg(F.count(F.lit(1)).alias("records")),
    "n5_drop_test_domains": lambda s, sf: N.drop_test_domains(host_rows(s, sf).select("page_id", "domain")),
    "n7_dedupe_first": lambda s, sf: N.dedupe_first(
        host_rows(s, sf).select("domain", "page_id", "expires"), ["domain"], "page_id"),
    "n8_flag_record_type": lambda s, sf: N.flag_record_type(
        N.normalize_godaddy_records(godaddy_record_docs(s, sf), AS_OF)).select(
        "domain", "subdomain", "record_type", "data", "valid_record_type"),
    "x1_is_test_domain": lambda s, sf: host_rows(s, sf).select(
        "page_id", E.is_test_domain("domain").alias("is_test")),
    "x2_x4_normalize": lambda s, sf: host_rows(s, sf).select(
        "page_id", E.normalize_subdomain("rname").alias("subdomain"),
        E.normalize_record_type("rtype").alias("record_type")),
    "x3_extract_subdomain": lambda s, sf: host_rows(s, sf).select(
        "page_id", E.extract_subdomain(F.col("host"), F.col("d3")).alias("sub_in"),
        E.extract_subdomain(F.concat(F.col("host"), F.lit(".")), F.upper("d3")).alias("sub_dot"),
        E.extract_subdomain(F.col("host"), F.lit("elsewhere.org")).alias("sub_out")),
    "x5_x6_fqdn_details": lambda s, sf: host_rows(s, sf).select(
        "page_id", E.fqdn(E.normalize_subdomain("rname"), F.col("d3")).alias("fqdn"),
        E.record_details(E.normalize_record_type("rtype"), F.col("url")).alias("details")),
    "x11_parse_rfc3339": lambda s, sf: X.finalize(host_rows(s, sf).select(
        "page_id", E.parse_rfc3339_date("expires").alias("expiry_date"))),
    "x12_trim_unicode": lambda s, sf: host_rows(s, sf).select(
        "page_id", E.trim_unicode("domain").alias("trimmed")),
    "x13_num_prefix": lambda s, sf: host_rows(s, sf).select(
        "page_id", E.num_prefix(F.regexp_extract("url", r"/(\d+[^/]*)$", 1)).alias("num")),
}

# --- SQL twins ---------------------------------------------------------------
HOSTS = r"""h0 AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages),
h AS (SELECT *, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS d3 FROM h0),
hr AS (SELECT page_id, url, host, d3,
  CASE page_id % 5 WHEN 0 THEN 'test-' || d3 WHEN 1 THEN 'Demo.' || d3 WHEN 2 THEN ' ' || upper(d3) || chr(9)
       WHEN 3 THEN d3 ELSE 'example.com' END AS domain,
  CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'not-a-date'
       ELSE printf('2026-%02d-%02dT10:00:00-07:00', page_id % 12 + 1, page_id % 28 + 1) END AS expires,
  CASE page_id % 4 WHEN 0 THEN '@' WHEN 1 THEN ' WWW ' WHEN 2 THEN chr(9) || 'mail' || chr(10)
       ELSE split_part(host, '.', 1) END AS rname,
  CASE WHEN page_id % 7 = 0 THEN 'bogus' WHEN page_id % 3 = 0 THEN ' a ' WHEN page_id % 3 = 1 THEN 'cname'
       ELSE 'TXT ' END AS rtype,
  page_id * 1.5 AS ttl, CASE WHEN page_id % 2 = 0 THEN page_id % 10 END AS priority FROM h)"""


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _is_test(x: str) -> str:
    t = f"lower({_trim(x)})"
    names = ", ".join(f"'{n}'" for n in E.TEST_DOMAIN_NAMES)
    prefixes = " OR ".join(f"starts_with({t}, '{p}')" for p in E.TEST_DOMAIN_PREFIXES)
    return f"(coalesce({t} IN ({names}) OR {prefixes}, false))"


def _sub(x: str) -> str:
    t = _trim(x)
    return f"CASE WHEN {t} = '@' THEN '' ELSE lower({t}) END"


def _rtype(x: str) -> str:
    return f"upper({_trim(x)})"


def _strip_dot(x: str) -> str:
    return f"CASE WHEN ends_with({x}, '.') THEN substr({x}, 1, length({x}) - 1) ELSE {x} END"


def _extract(host: str, dom: str) -> str:
    h = _strip_dot(f"lower({_trim(host)})")
    d = _strip_dot(f"lower({_trim(dom)})")
    return (f"CASE WHEN {h} = {d} THEN '' WHEN ends_with({h}, '.' || {d}) "
            f"THEN substr({h}, 1, length({h}) - length({d}) - 1) ELSE {h} END")


RFC = r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})"
_PARSE = (f"CASE WHEN regexp_full_match(expires, '{RFC}') "
          "THEN strftime(CAST(substr(expires, 1, 10) AS DATE), '%Y-%m-%d') END")
_DATES = "'2024-02-01' AS discovery_date, '2024-02-01' AS last_seen"

ZONES = r"""zs AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 9 = 4 THEN '' ELSE 'z' || CAST(s_suppkey AS VARCHAR) END AS id,
  CASE s_suppkey % 6 WHEN 0 THEN 'example.org' WHEN 1 THEN 'dev-supplier-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.io'
       WHEN 2 THEN '' ELSE 'supplier-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.io' END AS name,
  s_suppkey // 20 AS _doc FROM supplier),
zok AS (SELECT * FROM zs WHERE _doc % 7 <> 3 AND id <> '' AND name <> ''),
zones AS (SELECT id AS zone_id, name AS domain FROM zok WHERE NOT """ + _is_test("name") + ")"

RECS = r"""rs AS (SELECT c_custkey AS k, 'z' || CAST(c_custkey % 100 AS VARCHAR) AS zone_id, c_custkey % 100 AS zk,
  'supplier-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0') || '.io' AS zn,
  CASE WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN ' mx' ELSE 'Txt' END AS type,
  c_name AS content, CASE WHEN c_custkey % 2 = 1 THEN 1 ELSE 300 END AS ttl,
  CASE WHEN c_custkey % 3 = 1 THEN 10 END AS priority FROM customer),
rs2 AS (SELECT *, CASE k % 4 WHEN 0 THEN zn WHEN 1 THEN 'www.' || zn || '.' WHEN 2 THEN 'API.' || upper(zn)
  ELSE 'other.net' END AS name FROM rs WHERE zk % 10 <> 7),
rj AS (SELECT rs2.*, zones.domain AS zone_name FROM rs2 JOIN zones ON rs2.zone_id = zones.zone_id)"""

def kept(name: str, where: str = "true") -> str:
    """CTE ``name``: the domains that N1 keeps of the pages ``where``."""
    return (f"{name} AS (SELECT DISTINCT domain FROM hr WHERE domain IS NOT NULL AND domain <> '' "
            f"AND NOT {_is_test('domain')} AND {where})")


def records_of(name: str, domains: str, where: str = "true") -> str:
    """CTE ``name``: all records of the pages ``where`` whose domain is among ``domains``."""
    return (f"{name} AS (SELECT d3 AS domain, {_sub('rname')} AS subdomain, {_rtype('rtype')} AS record_type, url AS data "
            f"FROM hr WHERE d3 <> '' AND d3 IN (SELECT domain FROM {domains}) AND {where})")


SQL = {
    "n2_kept_domains": "WITH " + HOSTS + f""", {kept('kd')}
SELECT d3 AS domain, {_sub('rname')} AS subdomain, {_rtype('rtype')} AS record_type, url AS data,
  CAST(trunc(ttl) AS INTEGER) AS ttl, CAST(coalesce(priority, 0) AS INTEGER) AS priority,
  'GoDaddy' AS source, 'active' AS status, {_DATES} FROM hr WHERE d3 <> '' AND d3 IN (SELECT domain FROM kd)""",
    "n1_godaddy_domains": "WITH " + HOSTS + f""",
f AS (SELECT * FROM hr WHERE domain IS NOT NULL AND domain <> ''),
fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM f) WHERE rn = 1)
SELECT domain, 'GoDaddy' AS registrar, 'active' AS status, {_PARSE} AS expiry_date,
  CAST(to_json(struct_pack(domain := domain, expires := expires)) AS VARCHAR) AS raw_data, {_DATES}
FROM fs WHERE NOT {_is_test('domain')}""",
    "n2_godaddy_records": "WITH " + HOSTS + f"""
SELECT d3 AS domain, {_sub('rname')} AS subdomain, {_rtype('rtype')} AS record_type, url AS data,
  CAST(trunc(ttl) AS INTEGER) AS ttl, CAST(coalesce(priority, 0) AS INTEGER) AS priority,
  'GoDaddy' AS source, 'active' AS status, {_DATES} FROM hr WHERE d3 <> ''""",
    "n3_cloudflare_zones": "WITH " + ZONES + f"""
SELECT zone_id, domain, 'Cloudflare' AS registrar, 'active' AS status, CAST(NULL AS VARCHAR) AS expiry_date,
  {_DATES} FROM zones""",
    "n3_cloudflare_errors": """SELECT DISTINCT s_suppkey // 20 AS _doc, 'bad token' AS error FROM supplier
WHERE (s_suppkey // 20) % 7 = 3""",
    "n4_cloudflare_records": "WITH " + ZONES + ", " + RECS + f"""
SELECT zone_name AS domain, {_extract('name', 'zone_name')} AS subdomain, {_rtype('type')} AS record_type,
  content AS data, ttl, CAST(coalesce(priority, 0) AS INTEGER) AS priority, 'Cloudflare' AS source,
  'active' AS status, {_DATES} FROM rj""",
    "j4_attach_zone": "WITH " + ZONES + ", " + RECS + """
SELECT zone_id, zone_name, CAST(count(*) AS BIGINT) AS records FROM rj GROUP BY 1, 2""",
    "n5_drop_test_domains": "WITH " + HOSTS + f" SELECT page_id, domain FROM hr WHERE NOT {_is_test('domain')}",
    "n7_dedupe_first": "WITH " + HOSTS + """ SELECT domain, page_id, expires FROM (SELECT *,
  row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn FROM hr) WHERE rn = 1""",
    "n8_flag_record_type": "WITH " + HOSTS + f"""
SELECT d3 AS domain, {_sub('rname')} AS subdomain, {_rtype('rtype')} AS record_type, url AS data,
  {_rtype('rtype')} IN ({", ".join(f"'{t}'" for t in E.VALID_RECORD_TYPES)}) AS valid_record_type
FROM hr WHERE d3 <> ''""",
    "x1_is_test_domain": "WITH " + HOSTS + f" SELECT page_id, {_is_test('domain')} AS is_test FROM hr",
    "x2_x4_normalize": "WITH " + HOSTS + f""" SELECT page_id, {_sub('rname')} AS subdomain,
  {_rtype('rtype')} AS record_type FROM hr""",
    "x3_extract_subdomain": "WITH " + HOSTS + f""" SELECT page_id, {_extract('host', 'd3')} AS sub_in,
  {_extract("host || '.'", 'upper(d3)')} AS sub_dot, {_extract('host', "'elsewhere.org'")} AS sub_out FROM hr""",
    "x5_x6_fqdn_details": "WITH " + HOSTS + f""" SELECT page_id,
  CASE WHEN {_sub('rname')} = '' THEN d3 ELSE {_sub('rname')} || '.' || d3 END AS fqdn,
  {_rtype('rtype')} || ' record - ' || url AS details FROM hr""",
    "x11_parse_rfc3339": "WITH " + HOSTS + f" SELECT page_id, {_PARSE} AS expiry_date FROM hr",
    "x12_trim_unicode": "WITH " + HOSTS + f" SELECT page_id, {_trim('domain')} AS trimmed FROM hr",
    "x13_num_prefix": "WITH " + HOSTS + r""", n AS (SELECT page_id,
  regexp_extract(regexp_extract(url, '/(\d+[^/]*)$', 1), '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS m FROM hr)
SELECT page_id, CASE WHEN m <> '' THEN TRY_CAST(m AS DOUBLE) END AS num FROM n""",
}

"""Sources: asset files, service catalogs, landed responses, snapshots.

JSON array files are not splittable, so each file is one task; land them
once as Parquet (``land_as_parquet``) and query the Parquet copy at scale.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.operators.runs import read_metadata  # noqa: F401  (S4, re-exported)
from skyledger.operators.unify import Service
from skyledger.sources import claims
from skyledger.sources.envelope import files_by_layout, layout_of, read_lines


# Hadoop file-system helpers (listing only; all data moves through Spark) ----
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when the path (or glob pattern) names at least one file or folder."""
    fs, p = _fs(spark, path)
    if any(ch in path for ch in "*?[{"):
        found = fs.globStatus(p)
        return found is not None and len(found) > 0
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()]


# S5 -------------------------------------------------------------------------
def read_landed(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Landed responses as (_doc, value): one whole document per file, or
    with ``lines`` one document per line (then ``_doc`` = file and line)."""
    if not lines:
        return (spark.read.text(path, wholetext=True)
                .select(F.col("_metadata.file_path").alias("_doc"), "value"))
    df = spark.read.text(path)
    return df.select(F.struct(F.col("_metadata.file_path").alias("file"),
                              F.col("_metadata.file_block_start").alias("block"),
                              F.monotonically_increasing_id().alias("line")).alias("_doc"), "value")


# S1 -------------------------------------------------------------------------
def read_assets(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One asset table from JSON array file(s), one row per element with its
    position as ``_ordinal``, or from JSON lines (told by the first character),
    which are split over many tasks. A file that is not an array and a line
    that is no object of the schema yield no rows; ``envelope.read_lines`` and
    ``envelope.read_envelope`` report them."""
    if schema is None:
        schema = spark.read.option("multiLine", layout_of(spark, path) != "lines").json(path).schema
        schema = T.StructType([f for f in schema.fields if f.name != "_corrupt_record"])
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if layout_of(spark, path) == "lines":
        rows, _ = read_lines(spark, path, schema)
        return rows.select(F.struct("_file", "_ordinal").alias("_source"),
                           *[F.col(f"`{f.name}`") for f in schema.fields], "_ordinal")
    docs = read_landed(spark, path).filter(F.ltrim("value").startswith("["))
    arr = F.from_json("value", T.ArrayType(schema))
    return (docs.select("_doc", F.posexplode(arr).alias("_pos", "r"))
            .select(F.struct("_doc", "_pos").alias("_source"), "r.*",
                    F.col("_pos").cast("long").alias("_ordinal")))


def land_as_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Land an asset table as Parquet (keeps ``_ordinal``/``_source``)."""
    df.write.mode(mode).parquet(path)


def read_parquet_with_ordinal(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with a deterministic input ordinal ``(file, row index)``,
    for first/last-row rules (the dedupes) on Parquet inputs."""
    df = spark.read.parquet(path)
    return df.withColumn("_ordinal", F.struct(F.col("_metadata.file_path").alias("file"),
                                              F.col("_metadata.row_index").alias("row")))


# S3 bootstrap: an existing inventory's exports or database -------------------
DOMAINS_FILE_DDL = ("domain STRING, status STRING, registrar STRING, expiry_date STRING, "
                    "discovery_date STRING, last_seen STRING")
DNS_FILE_DDL = ("domain STRING, subdomain STRING, type STRING, data STRING, source STRING, status STRING, "
                "discovery_date STRING, last_seen STRING")


def _date(c: str):
    return F.to_date(F.try_to_timestamp(F.substring(F.col(c), 1, 10), F.lit("yyyy-MM-dd")))


def read_domains_json(spark: SparkSession, path: str) -> DataFrame:
    """Domain export/sample files (JSON arrays or JSON lines) -> domain
    snapshot rows; dates parsed, missing ones stay null."""
    from skyledger.schemas import DOMAINS_DDL
    df = _json_rows(spark, path, DOMAINS_FILE_DDL)
    out = df.select("domain", "registrar", "status", _date("expiry_date").alias("expiry_date"),
                    _date("discovery_date").alias("discovery_date"), _date("last_seen").alias("last_seen"),
                    F.lit(None).cast("string").alias("raw_data"), F.lit(None).cast("timestamp").alias("created_at"),
                    F.lit(None).cast("timestamp").alias("updated_at"))
    return out.select(*[f.name for f in T.StructType.fromDDL(DOMAINS_DDL).fields])


def read_dns_json(spark: SparkSession, path: str) -> DataFrame:
    """DNS record export/sample files -> DNS snapshot rows: ``type`` becomes
    ``record_type`` and the root subdomain ``@`` becomes '' (X2)."""
    from skyledger.functions.expr import normalize_subdomain
    df = _json_rows(spark, path, DNS_FILE_DDL)
    return df.select("domain", normalize_subdomain(F.coalesce("subdomain", F.lit(""))).alias("subdomain"),
                     F.col("type").alias("record_type"), "data", F.lit(None).cast("int").alias("ttl"),
                     F.lit(None).cast("int").alias("priority"), "source", "status",
                     _date("discovery_date").alias("discovery_date"), _date("last_seen").alias("last_seen"),
                     F.lit(None).cast("string").alias("raw_data"), F.lit(None).cast("timestamp").alias("created_at"),
                     F.lit(None).cast("timestamp").alias("updated_at"))


def _json_rows(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of JSON array files and JSON-lines files alike. An array is one
    document of one task; files of lines are split and read line by line."""
    schema = T.StructType.fromDDL(ddl)
    spark.read.text(path)  # refuses a missing path
    arrays, lines = files_by_layout(spark, path)
    out = spark.createDataFrame([], schema)
    if arrays:
        out = out.unionByName(read_landed(spark, arrays).select(F.explode(F.from_json("value", T.ArrayType(schema))).alias("r")).select("r.*"))
    if lines:
        text = spark.read.text(lines, lineSep="\n").filter(F.trim("value") != "")
        out = out.unionByName(text.select(F.from_json("value", schema).alias("r")).select("r.*"))
    return out


def read_table_jdbc(spark: SparkSession, url: str, table: str, properties: dict, partition_column: str | None = None,
                    lower: int | None = None, upper: int | None = None, partitions: int | None = None) -> DataFrame:
    """A table of a database the user keeps (the driver jar must be on the
    classpath). Give a numeric ``partition_column`` with bounds to read in
    parallel ranges instead of one connection."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


# S2 -------------------------------------------------------------------------
@dataclass(frozen=True)
class CatalogEntry:
    provider: str
    service: str
    path: str
    label: str = ""
    page: str = ""
    name_field: str | None = None


def read_catalog(spark: SparkSession, manifest: list[CatalogEntry], schemas: dict | None = None
                 ) -> tuple[list[Service], DataFrame]:
    """Read every catalog entry; unreadable paths are skipped and reported in
    the second frame instead of being hidden."""
    services, skipped = [], []
    for e in manifest:
        if not path_exists(spark, e.path):
            skipped.append((e.provider, e.service, e.path))
            continue
        df = read_assets(spark, e.path, (schemas or {}).get(e.service))
        services.append(Service(e.provider, e.service, df, e.name_field, e.page, e.label))
    return services, spark.createDataFrame(skipped, "provider string, service string, path string")


# S3 / K6: versioned snapshots ------------------------------------------------
def _versions(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    out = []
    for d in list_dirs(spark, base):
        name = d.rstrip("/").rsplit("/", 1)[-1]
        if name.startswith("v=") and name[2:].isdigit() and path_exists(spark, d + "/_SUCCESS"):
            out.append((int(name[2:]), d))
    return sorted(out)


def latest_version(spark: SparkSession, base: str) -> int | None:
    v = _versions(spark, base)
    return v[-1][0] if v else None


def _next_version(spark: SparkSession, base: str) -> tuple[int, str]:
    """Next version number after the newest committed one, and the write
    mode: a folder left by a failed attempt (no ``_SUCCESS``) is replaced,
    a committed one never is."""
    cur = latest_version(spark, base)
    nxt = 0 if cur is None else cur + 1
    target = f"{base.rstrip('/')}/v={nxt}"
    return nxt, ("overwrite" if path_exists(spark, target) else "errorifexists")


def read_snapshot(spark: SparkSession, base: str, version: int | None = None,
                  schema: str | None = None, before: int | None = None) -> DataFrame:
    """Current snapshot = the newest committed ``v=<n>`` directory (or a
    pinned one, or the newest below ``before``); an empty frame of
    ``schema`` when nothing is committed."""
    vs = dict(_versions(spark, base))
    if before is not None:
        vs = {k: v for k, v in vs.items() if k < before}
    if version is None and vs:
        version = max(vs)
    if version is None or version not in vs:
        if schema is None:
            raise FileNotFoundError(f"no committed snapshot under {base}")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", vs[version])
    return reader.parquet(vs[version])


def commit_snapshot(df: DataFrame, base: str, partition_by: str | None = None,
                    sort_within: list[str] | None = ("domain",)) -> int:
    """Write a new version directory; readers switch when Spark's commit
    marker appears, and the directory being read is never overwritten.
    Rows are sorted by ``sort_within`` inside each file (no shuffle), so
    Parquet min/max statistics let lookups by domain skip row groups."""
    spark = df.sparkSession
    nxt, mode = _next_version(spark, base)
    keys = [c for c in (sort_within or []) if c in df.columns]
    if keys:
        df = df.sortWithinPartitions(*keys)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(f"{base.rstrip('/')}/v={nxt}")
    return nxt


# Per-source snapshot store ----------------------------------------------------
class SnapshotStore:
    """Snapshot kept as ``<base>/<col>=<value>/v=<n>``: a merge of one source
    commits a new version of that source's partition only, so other sources'
    data is never rewritten. Readers take the newest committed version of
    every partition."""

    def __init__(self, spark: SparkSession, base: str, col: str, schema: str, sub_partition: str | None = None,
                 lookups: tuple[str, ...] = ("domain",)):
        """``sub_partition`` (e.g. ``status``) splits each version folder once
        more, so filters on it (views drop removed rows) prune whole folders;
        removed rows accumulate over time and are then never read by views.
        ``lookups`` are columns with a Bloom filter in every row group, so a
        lookup of one value opens the row groups that have it."""
        self.spark, self.base, self.col, self.schema = spark, base.rstrip("/"), col, schema
        self.sub_partition, self.lookups = sub_partition, tuple(lookups)

    def _partition(self, value: str) -> str:
        return f"{self.base}/{self.col}={value}"

    def read(self, before: int | None = None, only: str | None = None) -> DataFrame:
        """Newest committed version of every partition, or of partition
        ``only`` (below ``before`` when given, so a replayed commit never
        reads its own output)."""
        paths = []
        dirs = [self._partition(only)] if only is not None else list_dirs(self.spark, self.base)
        for d in dirs:
            vs = [v for v in _versions(self.spark, d) if before is None or v[0] < before]
            if vs:
                paths.append(vs[-1][1])
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.option("basePath", self.base).parquet(*paths)
        cols = [f.name for f in T.StructType.fromDDL(self.schema).fields]
        return df.select(*cols)

    def reserve(self, value: str, run_id: str) -> int:
        """Version that run ``run_id`` commits: the one it holds (a replay), or
        the next number that nobody has claimed. A claim is a file that can be
        created once, so no number is handed out twice. A replay of an
        uncommitted run takes a new number when a later version has been
        committed meanwhile."""
        part = self._partition(value)
        committed = [n for n, _ in _versions(self.spark, part)]
        mine = f"{part}/claims/run={quote(run_id, safe='')}"
        told = claims.owner_of(self.spark, mine)
        if told and (int(told) in committed or int(told) > max(committed, default=-1)):
            return int(told)
        taken = [int(n[2:]) for n in claims.names(self.spark, f"{part}/claims") if n.startswith("v=")]
        n = max(committed + taken, default=-1) + 1
        while not claims.take(self.spark, f"{part}/claims/v={n}", run_id):
            n += 1
        for old in taken:
            if old < max(committed, default=-1):  # a new number is always larger
                claims.drop(self.spark, f"{part}/claims/v={old}")
        if told:
            claims.drop(self.spark, mine)
        claims.take(self.spark, mine, str(n))
        return n

    def is_committed(self, value: str, version: int) -> bool:
        return path_exists(self.spark, f"{self._partition(value)}/v={version}/_SUCCESS")

    def commit(self, rows: DataFrame, value: str, version: int | None = None, metrics: dict[str, Column] | None = None) -> int:
        """Commit the complete new rows of one source as its next version, or
        as the ``version`` its run has reserved. A committed version is never
        written again: the replay of a committed run keeps it.

        Kept with the version, from the one pass that writes it: the status
        counts of its rows and ``metrics`` (aggregates over ``rows``, whose
        further columns serve them and are not stored)."""
        part = self._partition(value)
        nxt = self.reserve(value, uuid.uuid4().hex) if version is None else version
        if self.is_committed(value, nxt):
            return nxt
        stored = [f.name for f in T.StructType.fromDDL(self.schema).fields if f.name in rows.columns and f.name != self.col]
        seen = Observation()
        status = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(status == "active").alias("active"),
                            F.count_if(status == "removed").alias("removed"), *[c.alias(f"m_{k}") for k, c in (metrics or {}).items()])
        rows = rows.select(*stored)
        if "domain" in rows.columns:
            rows = rows.sortWithinPartitions("domain")
        w = rows.write.mode("overwrite")  # an uncommitted folder is what a failed attempt of this version left
        for key in self.lookups:
            if key in rows.columns:
                w = w.option(f"parquet.bloom.filter.enabled#{key}", "true")
        if self.sub_partition:
            w = w.partitionBy(self.sub_partition)
        w.parquet(f"{part}/v={nxt}")
        kept = {k: int(v or 0) for k, v in seen.get.items()}
        where = f"{part}/kept/v={nxt}"
        if not claims.take(self.spark, where, json.dumps(kept)):
            claims.drop(self.spark, where)
            claims.take(self.spark, where, json.dumps(kept))
        return nxt

    def kept(self, value: str, version: int) -> dict[str, int] | None:
        """The counts and metrics kept with a version; None if it was written without."""
        told = claims.owner_of(self.spark, f"{self._partition(value)}/kept/v={version}")
        return json.loads(told) if told else None

    def counts(self) -> DataFrame:
        """Total, active and removed rows of each source, from what is kept with
        the newest versions; no row of a snapshot is read. (A version without
        kept counts is counted.)"""
        out = []
        for d in list_dirs(self.spark, self.base):
            vs = _versions(self.spark, d)
            value = unquote(d.rstrip("/").rsplit("/", 1)[-1].split("=", 1)[-1])
            if not vs:
                continue
            k = self.kept(value, vs[-1][0])
            if k is None:
                r = self.read(only=value).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "active").alias("active"),
                                              F.count_if(F.col("status") == "removed").alias("removed")).first()
                k = r.asDict()
            out.append((value, k["total"], k["active"], k["removed"]))
        return self.spark.createDataFrame(out, f"`{self.col}` string, total long, active long, removed long")


# Bucketed snapshot -------------------------------------------------------------
class BucketedSnapshot:
    """Snapshot versions kept as external tables bucketed (and sorted) by the
    natural key: ``<name>_v<n>`` at ``<base>/v=<n>``. A merge then finds the
    snapshot side already hash-partitioned on the join key, so only the batch
    is shuffled - the snapshot, the large side, never moves. Bucket on the
    natural key without the source column (a merge fixes the source, and
    ``partition_by`` the source prunes other sources). Use as many buckets as
    the snapshot needs partitions (~128 MB each) and run merges with
    ``spark.sql.shuffle.partitions`` equal to it, so the batch is shuffled
    exactly once."""

    def __init__(self, spark: SparkSession, base: str, name: str, keys: list[str], buckets: int,
                 partition_by: str | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        # tables of one name in different folders are different tables
        self.name = f"{name}_{hashlib.sha256(self._location(self.base).encode()).hexdigest()[:12]}"
        self.keys, self.buckets, self.partition_by = list(keys), buckets, partition_by

    def _location(self, path: str) -> str:
        fs, p = _fs(self.spark, path)
        return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri().getPath().rstrip("/")

    def _registered(self, table: str) -> str:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").collect()
        return self._location(rows[0]["data_type"]) if rows else ""

    def _tables(self) -> list[tuple[int, str]]:
        """Committed versions, found by folder and ``_SUCCESS`` marker; one
        that this session's catalog does not know yet is registered."""
        known = {t.name for t in self.spark.catalog.listTables()}
        out = []
        for n, path in _versions(self.spark, self.base):
            table = f"{self.name}_v{n}"
            if table.lower() not in known:
                self._register(table, path)
            elif self._registered(table) != self._location(path):  # an external table: its files stay
                self.spark.sql(f"DROP TABLE {table}")
                self._register(table, path)
            out.append((n, table))
        return out

    def _register(self, table: str, path: str) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema.fields)
        keys = ", ".join(f"`{k}`" for k in self.keys)
        parts = f"PARTITIONED BY (`{self.partition_by}`) " if self.partition_by else ""
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {parts}"
                       f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        if self.partition_by:
            self.spark.catalog.recoverPartitions(table)

    def latest(self) -> int | None:
        t = self._tables()
        return t[-1][0] if t else None

    def read(self) -> DataFrame:
        t = self._tables()
        if not t:
            raise FileNotFoundError(f"no committed version of {self.name}")
        return self.spark.table(t[-1][1])

    def commit(self, df: DataFrame) -> int:
        cur = self.latest()
        nxt = 0 if cur is None else cur + 1
        while path_exists(self.spark, f"{self.base}/v={nxt}"):  # a failed attempt keeps its folder and number
            nxt += 1
        target = f"{self.base}/v={nxt}"
        w = df.repartition(self.buckets, *self.keys).write.option("path", target)
        if self.partition_by:
            w = w.partitionBy(self.partition_by)
        (w.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).mode("errorifexists")
         .saveAsTable(f"{self.name}_v{nxt}"))
        return nxt

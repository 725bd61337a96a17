"""Merge a collection batch into the inventory snapshot.

The reference upserts row by row and then sweeps stale rows with one UPDATE
per domain. Here one batch is one plan:

* the batch is reduced to one row per natural key with a partial aggregation
  (last payload wins, duplicates counted) - hot keys are combined map-side;
  the source is fixed for one merge, so grouping and joining use the rest of
  the key and the batch's aggregation shuffle is reused by the join;
* the snapshot rows of the batch's source are matched to it with a single
  ``full_outer`` equi-join on the natural key (keys are unique on both sides,
  so no join key can be skewed);
* the removal scope of DNS records (domains present in the batch) is a plain
  join on ``domain``: the planner broadcasts the set when its bytes allow,
  otherwise AQE splits the join when one domain is hot;
* rows of other sources never enter the join.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.schemas import DNS_KEY, DOMAIN_KEY

CHANGE_ADDED = "added"
CHANGE_UPDATED = "updated"
CHANGE_REACTIVATED = "reactivated"
CHANGE_REMOVED = "removed"
CHANGE_UNCHANGED = "unchanged"


def _date_lit(d) -> Column:
    if isinstance(d, Column):
        return d.cast("date")
    return F.lit(d if isinstance(d, date) else str(d)).cast("date")


def _ts_lit(ts) -> Column:
    if ts is None:
        return F.current_timestamp()
    if isinstance(ts, Column):
        return ts.cast("timestamp")
    return F.lit(ts if isinstance(ts, datetime) else str(ts)).cast("timestamp")


# N7 -------------------------------------------------------------------------
def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key in ``order`` (deterministic, partial aggregation)."""
    payload = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.col(order)).alias("_p"))
    return agg.select(*keys, "_p.*")


# M5 -------------------------------------------------------------------------
def dedupe_last(df: DataFrame, keys: list[str], order: str, count_col: str = "_n") -> DataFrame:
    """Last row per key in ``order`` plus the number of rows of the key."""
    payload = [c for c in df.columns if c not in keys and c != order]
    agg = df.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.col(order)).alias("_p"),
        F.count(F.lit(1)).alias(count_col))
    return agg.select(*keys, "_p.*", count_col)


# J2 -------------------------------------------------------------------------
def scope_to_batch(snapshot: DataFrame, batch_domains: DataFrame) -> DataFrame:
    """Add ``_scope`` = the row's domain is among ``batch_domains``.

    A plain left join on the distinct domains: the planner broadcasts the set
    when its runtime bytes allow, and no job runs while the plan is built. The
    set is spread by a hash of the domain, so the join shuffles it anew: as a
    shuffle of its own AQE can pair it with the splits of a snapshot partition
    that holds a hot domain (the distinct's own shuffle would block that)."""
    scope = (batch_domains.select("domain").distinct().withColumn("_scope", F.lit(True))
             .repartition(F.xxhash64("domain")))
    return (snapshot.join(scope, "domain", "left")
            .withColumn("_scope", F.coalesce(F.col("_scope"), F.lit(False))))


def stat_columns() -> dict[str, Column]:
    """M3 as aggregates over ``MergeResult.joined``, also for ``observe`` while it is written; ``found``: batch rows."""
    found = F.coalesce(F.sum("_n"), F.lit(0)).cast("long")
    added = F.count_if(F.col("change") == CHANGE_ADDED).cast("long")
    return {"found": found, "added": added, "updated": found - added,
            "removed": F.count_if(F.col("change") == CHANGE_REMOVED).cast("long"),
            "reactivated": F.count_if(F.col("change") == CHANGE_REACTIVATED).cast("long")}


@dataclass
class MergeResult:
    """Outcome of one merge. ``joined`` holds every snapshot row of the
    source and every batch key with its ``change``; ``snapshot`` is the new
    full snapshot; ``stats`` and ``changes`` derive from ``joined``."""

    joined: DataFrame
    others: DataFrame
    columns: list[str]
    keys: list[str]

    @property
    def snapshot(self) -> DataFrame:
        return self.joined.select(*self.columns).unionByName(self.others.select(*self.columns))

    @property
    def source_rows(self) -> DataFrame:
        """The new rows of the merged source only (what a per-source store
        commits; other sources stay where they are)."""
        return self.joined.select(*self.columns)

    @property
    def changes(self) -> DataFrame:
        """M4: key and change kind of every row of the merged source."""
        return self.joined.select(*self.keys, "change")

    @property
    def stats(self) -> DataFrame:
        """M3: added (new keys), updated (batch rows - added), removed (flips)."""
        columns = stat_columns()
        return self.joined.agg(*[columns[c].alias(c) for c in ("added", "updated", "removed", "reactivated")])

    def persist(self) -> "MergeResult":
        self.joined = self.joined.persist(StorageLevel.MEMORY_AND_DISK)
        return self


def _merge(snapshot: DataFrame, batch: DataFrame, keys: list[str], source_col: str,
           source: str, as_of, now, payload: list[str], mode: str,
           scope: DataFrame | None, columns: list[str]) -> MergeResult:
    d = _date_lit(as_of)
    ts = _ts_lit(now)
    own = F.col(source_col) == F.lit(source)
    s_src = snapshot.filter(own)
    others = snapshot.filter(~own | F.col(source_col).isNull())
    # the source is fixed for one merge: dedupe and join on the rest of the
    # natural key, so the batch is shuffled once and a snapshot bucketed on
    # that key is joined without moving it
    jkeys = [k for k in keys if k != source_col]

    b = batch
    if "_ordinal" not in b.columns:
        b = b.withColumn("_ordinal", F.monotonically_increasing_id())
    bd = dedupe_last(b.select(*jkeys, *payload, "_ordinal"), jkeys, "_ordinal")

    s_cols = [c for c in s_src.columns if c not in keys]
    s = s_src.select(*jkeys, *[F.col(c).alias("s_" + c) for c in s_cols], F.lit(True).alias("_s"))
    if scope is not None:
        s = scope_to_batch(s, scope)
    else:
        s = s.withColumn("_scope", F.lit(True))
    bb = bd.select(*jkeys, *[F.col(c).alias("b_" + c) for c in payload], "_n",
                   F.lit(True).alias("_b"))

    j = s.join(bb, jkeys, "full_outer")
    in_b = F.coalesce(F.col("_b"), F.lit(False))
    in_s = F.coalesce(F.col("_s"), F.lit(False))
    stale = (F.col("s_last_seen") < d) if mode == "date" else F.lit(True)
    flip = ~in_b & in_s & F.col("_scope") & (F.col("s_status") == "active") & stale
    change = (F.when(in_b & ~in_s, F.lit(CHANGE_ADDED))
              .when(in_b & (F.col("s_status") == "removed"), F.lit(CHANGE_REACTIVATED))
              .when(in_b, F.lit(CHANGE_UPDATED))
              .when(flip, F.lit(CHANGE_REMOVED))
              .otherwise(F.lit(CHANGE_UNCHANGED)))

    exprs = {
        source_col: F.lit(source),
        "status": F.when(in_b, F.lit("active")).when(flip, F.lit("removed")).otherwise(F.col("s_status")),
        "discovery_date": F.when(in_s, F.col("s_discovery_date")).otherwise(d),
        "last_seen": F.when(in_b, d).otherwise(F.col("s_last_seen")),
        "created_at": F.when(in_s, F.col("s_created_at")).otherwise(ts),
        "updated_at": F.when(in_b | flip, ts).otherwise(F.col("s_updated_at")),
    }
    for p in payload:
        exprs[p] = F.when(in_b, F.col("b_" + p)).otherwise(F.col("s_" + p))
    sel = [F.col(c) if c in jkeys else exprs[c].alias(c) for c in columns]
    joined = j.select(*sel, change.alias("change"), F.coalesce(F.col("_n"), F.lit(0)).alias("_n"))
    return MergeResult(joined=joined, others=others, columns=columns, keys=keys)


DOMAIN_COLUMNS = ["domain", "registrar", "status", "expiry_date", "discovery_date", "last_seen",
                  "raw_data", "created_at", "updated_at"]
DNS_COLUMNS = ["domain", "subdomain", "record_type", "data", "ttl", "priority", "source", "status",
               "discovery_date", "last_seen", "raw_data", "created_at", "updated_at"]


# M1 -------------------------------------------------------------------------
def merge_domains(snapshot: DataFrame, batch: DataFrame, source: str, as_of,
                  now=None, mode: str = "date") -> MergeResult:
    """Merge a batch of (domain, expiry_date, raw_data[, _ordinal]) of one
    registrar. ``mode='date'`` removes active rows of the source last seen
    before ``as_of`` (reference rule); ``mode='keys'`` removes every active
    row of the source absent from the batch."""
    return _merge(snapshot, batch, DOMAIN_KEY, "registrar", source, as_of, now,
                  ["expiry_date", "raw_data"], mode, None, DOMAIN_COLUMNS)


# M2 -------------------------------------------------------------------------
def merge_dns_records(snapshot: DataFrame, batch: DataFrame, source: str, as_of,
                      now=None, checked_domains: DataFrame | None = None,
                      mode: str = "date") -> MergeResult:
    """Merge a batch of DNS records of one source. Removal is limited to
    domains present in the batch, plus ``checked_domains`` when given (a
    checked domain with no records left then loses its old ones)."""
    scope = batch.select("domain")
    if checked_domains is not None:
        scope = scope.unionByName(checked_domains.select("domain"))
    return _merge(snapshot, batch, DNS_KEY, "source", source, as_of, now,
                  ["ttl", "priority", "raw_data"], mode, scope, DNS_COLUMNS)


# M3 / M4 --------------------------------------------------------------------
def merge_stats(result: MergeResult) -> DataFrame:
    """M3: one row of added / updated / removed / reactivated."""
    return result.stats


def change_log(result: MergeResult) -> DataFrame:
    """M4: key and change kind (added, updated, reactivated, removed,
    unchanged) of every row of the merged source."""
    return result.changes


def status_changes(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What a change log (M4) does to the status counts, per ``by`` columns: added rows are
    active, reactivated ones turn active again, removed ones stop being active."""
    n = lambda kind: F.count_if(F.col("change") == kind)
    moved = changes.groupBy(*by) if by else changes.groupBy()
    return moved.agg(n(CHANGE_ADDED).alias("total"), (n(CHANGE_ADDED) + n(CHANGE_REACTIVATED) - n(CHANGE_REMOVED)).alias("active"),
                     (n(CHANGE_REMOVED) - n(CHANGE_REACTIVATED)).alias("removed"))


def kept_counts(counts: DataFrame, changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1/A6 kept up to date: the status counts after a merge from those before it
    and its change log, so that the snapshot is not counted again."""
    names = ["total", "active", "removed"]
    both = counts.select(*(by or []), *names).unionByName(status_changes(changes.where(F.col("change") != CHANGE_UNCHANGED), by))
    return (both.groupBy(*by) if by else both.groupBy()).agg(*[F.sum(c).cast("long").alias(c) for c in names])


# J1 -------------------------------------------------------------------------
def match_batch(snapshot: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch-to-snapshot match by natural key: every key with side flags."""
    s = snapshot.select(*keys).distinct().withColumn("in_snapshot", F.lit(True))
    b = batch.select(*keys).distinct().withColumn("in_batch", F.lit(True))
    return (s.join(b, keys, "full_outer")
            .select(*keys, F.coalesce("in_snapshot", F.lit(False)).alias("in_snapshot"),
                    F.coalesce("in_batch", F.lit(False)).alias("in_batch")))


def combine_rows(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """Sum partial results column-wise into one row: each part supplies some
    of ``columns`` (missing ones count 0). One union and one aggregation -
    no join between the parts."""
    u = None
    for p in parts:
        q = p.select(*[(F.col(c) if c in p.columns else F.lit(0)).cast("long").alias(c) for c in columns])
        u = q if u is None else u.unionByName(q)
    return u.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# N6 -------------------------------------------------------------------------
def collection_stats(domains: DataFrame, records: DataFrame, start, end) -> DataFrame:
    """Domains and records found plus duration in seconds (one row)."""
    dur = (F.unix_timestamp(_ts_lit(end)) - F.unix_timestamp(_ts_lit(start))).cast("long")
    counts = combine_rows([_count(domains, "domains_found"), _count(records, "records_found")],
                          ["domains_found", "records_found"])
    return counts.select("domains_found", "records_found", dur.alias("duration_sec"))


# M6 -------------------------------------------------------------------------
@dataclass
class SyncResult:
    domains: DataFrame
    records: DataFrame
    stats: DataFrame


def run_sync(snap_domains: DataFrame, snap_records: DataFrame, domains: DataFrame,
             records: DataFrame, source: str, as_of, now=None,
             checked_domains: DataFrame | None = None) -> SyncResult:
    """One collection: merge domains and records (an empty batch skips its
    merge, so an empty fetch never removes everything) and sum the stats with
    found = domains + records."""
    parts = []
    out_dom, out_rec = snap_domains, snap_records
    if not domains.isEmpty():
        m = merge_domains(snap_domains, domains, source, as_of, now)
        out_dom = m.snapshot
        parts.append(m.stats)
    if not records.isEmpty():
        m = merge_dns_records(snap_records, records, source, as_of, now, checked_domains)
        out_rec = m.snapshot
        parts.append(m.stats)
    stats = combine_rows([_count(domains, "records_found"), _count(records, "records_found"), *parts],
                         ["records_found", "added", "updated", "removed", "reactivated"])
    return SyncResult(out_dom, out_rec, stats)

"""Incremental collection with Structured Streaming.

The reference runs a full fetch on a cron and merges it. Here a fetcher lands
provider responses as JSON lines, one envelope per response page:

    {"kind": "domains", "body": <GoDaddy domain page or Cloudflare zone envelope>}
    {"kind": "records", "domain": "a.io", "zone_id": "...", "body": <record page / envelope>}

The landed folder is a file stream; each micro-batch (``Trigger.AvailableNow``
for scheduled runs, or a processing-time trigger) is one collection run:
normalise, merge domains and records, commit the merged source partitions,
log the run (``collection.run_collection``). Progress lives in the stream
checkpoint, so a restarted job resumes after the last committed batch. A run
is named after the stream and its batch; the stores record the version each
run commits, so a replayed batch keeps its version and any other run, of
this or another stream or of the command line, takes the next free one.

A micro-batch is taken for a whole fetch, as when the fetch has landed before
the run starts. With a ``pending`` folder pages may land over several
micro-batches, in any order: every envelope then names its ``fetch`` (and may
give its ``page``), and the collection runs when ``{"kind": "end", "fetch": ...}``
has arrived and, if that names the number of ``pages``, all of them have
(``streaming.fetches``). It reads the landed files that hold pages of that
fetch, and no other. A fetch that never ends is logged as a failed run, and its
files are listed in the folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.collection import CollectionStores, fail_run, read_run_log, run_collection
from skyledger.operators import normalize as N
from skyledger.operators import runs as R
from skyledger.streaming import fetches as T

ENVELOPE = "kind STRING, fetch STRING, domain STRING, zone_id STRING, page LONG, pages LONG, body STRING"


def _envelopes(lines: DataFrame) -> DataFrame:
    """Landed lines as (_doc, e)."""
    return lines.select(F.struct("file", "block", F.monotonically_increasing_id().alias("line")).alias("_doc"),
                        F.from_json("value", ENVELOPE).alias("e"))


@dataclass
class IncrementalSync:
    landed_dir: str                  # folder a fetcher drops envelope lines into
    stores: CollectionStores         # per-source domain / record stores and the run log
    checkpoint: str                  # stream checkpoint folder (shared storage)
    provider: str = N.GODADDY
    as_of: Callable[[], str] | None = None   # date of a batch; default: the processing date
    pending: str | None = None       # pages may land over several micro-batches; what never ends is listed here
    fetch_timeout_ms: int = T.DEFAULT_TIMEOUT_MS   # time without news after which a fetch is given up

    def stream_id(self, spark: SparkSession) -> str:
        """Identity of the stream's checkpoint (a new one after a reset)."""
        return json.loads(spark.read.text(f"{self.checkpoint}/metadata").first()["value"])["id"]

    def _as_of(self, spark: SparkSession) -> str:
        return self.as_of() if self.as_of else spark.range(1).select(F.current_date().cast("string")).first()[0]

    def _name(self, spark: SparkSession) -> str:
        return f"{self.provider.lower()}-{self.stream_id(spark)}"

    def _batch(self, lines: DataFrame, epoch_id: int) -> None:
        """One micro-batch as one whole fetch."""
        spark = lines.sparkSession
        if lines.isEmpty():
            return
        self._collect(_envelopes(lines), self._as_of(spark), f"{self._name(spark)}-{epoch_id}", 2 * epoch_id)

    def _fetched(self, told: DataFrame, epoch_id: int) -> None:
        """The fetches that a micro-batch has completed or given up."""
        spark = told.sparkSession
        # a fetch ends once, so a micro-batch ends a handful; evaluated once, as the state moves with it
        for fetch in sorted(told.collect(), key=lambda r: r["fetch"]):
            run_id = f"{self._name(spark)}-fetch-{fetch['fetch']}"
            as_of = self._as_of(spark)
            if fetch["state"] == T.COMPLETE:
                lines = spark.read.text([unquote(f) for f in fetch["files"]]) if fetch["files"] else None
                if lines is not None:
                    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
                    env = _envelopes(lines).filter(F.col("e.fetch") == fetch["fetch"])
                    self._collect(env, as_of, run_id, 2 * epoch_id)
                continue
            listed = spark.createDataFrame([tuple(fetch)], T.FETCHES)
            listed.coalesce(1).write.mode("overwrite").parquet(f"{self.pending}/expired/{run_id}")
            fail_run(spark, self.stores, self.provider, run_id, f"{as_of} 00:00:00",
                     f"fetch {fetch['fetch']} never ended: {fetch['pages']} pages, {fetch['expected'] or 'no number'} expected")

    def _collect(self, env: DataFrame, as_of: str, run_id: str, event_seq: int) -> None:
        domain_docs = env.filter(F.col("e.kind") == "domains").select("_doc", F.col("e.body").alias("value"))
        record_docs = env.filter(F.col("e.kind") == "records").select(
            F.col("e.domain").alias("domain"), F.col("e.zone_id").alias("zone_id"), "_doc",
            F.col("e.body").alias("value"))
        run_collection(env.sparkSession, self.stores, self.provider, domain_docs, record_docs, as_of,
                       f"{as_of} 00:00:00", run_id, event_seq)

    def start(self, spark: SparkSession, available_now: bool = True, processing_time: str | None = None):
        stream = (spark.readStream.format("text").option("recursiveFileLookup", "true").load(self.landed_dir)
                  .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                          F.col("_metadata.file_modification_time").alias("landed"), "value"))
        sink = self._batch
        if self.pending is not None:
            pages = stream.select("file", "landed", F.from_json("value", ENVELOPE).alias("e")).filter(F.col("e.fetch").isNotNull())
            stream = T.track_fetches(pages.select(F.col("e.fetch").alias("fetch"), F.col("e.kind").alias("kind"), T.page_identity().alias("page"),
                                                  "file", "landed", F.col("e.pages").alias("expected")), self.fetch_timeout_ms)
            sink = self._fetched
        w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", self.checkpoint)
        if available_now:
            w = w.trigger(availableNow=True)
        elif processing_time:
            w = w.trigger(processingTime=processing_time)
        return w.start()

    def domains(self) -> DataFrame:
        return self.stores.domains.read()

    def records(self) -> DataFrame:
        return self.stores.records.read()

    def run_log(self, spark: SparkSession) -> DataFrame:
        return R.current_runs(read_run_log(spark, self.stores.run_log_dir))


def envelope_lines(docs: DataFrame, kind: str, fetch: str | None = None) -> DataFrame:
    """Wrap landed pages (``value`` = provider JSON, optional ``domain`` /
    ``zone_id``) as envelope lines for the landed folder."""
    cols = [F.lit(kind).alias("kind")] + ([F.lit(fetch).alias("fetch")] if fetch else [])
    for c in ("domain", "zone_id"):
        if c in docs.columns:
            cols.append(F.col(c))
    cols.append(F.parse_json("value").alias("body"))
    return docs.select(F.to_json(F.struct(*cols)).alias("value"))

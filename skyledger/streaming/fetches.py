"""Which fetches have landed completely: keyed stream state with an end marker and a timer.

A fetch lands as pages, over as many micro-batches as it likes and in any
order. The state of a fetch holds the identity and the file of each of its
pages, never their bodies, its end marker and its timer. When the marker has come
(and, if it says how many pages there are, all of them), the fetch is given
out once, with the files that hold its pages, and its state is cleared. A
fetch that goes without news for ``timeout_ms`` is given out as expired, and
cleared too. Time is that at which files land (the watermark stays ``timeout_ms``
behind the newest file), so a replay expires the same fetches as the first run.

A page is known by its ``page``, or by its content where it has none, so one
that is landed again counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

FETCHES = "fetch string, state string, pages long, expected long, files array<string>"
COMPLETE, EXPIRED = "complete", "expired"
DEFAULT_TIMEOUT_MS = 2 * 3_600_000  # as long as a run may be running before it counts as stale


def page_identity(kind: str = "e.kind", page: str = "e.page", content: tuple = ("e.kind", "e.domain", "e.zone_id", "e.body")):
    """``page`` of a page, or the digest of what it says."""
    told = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in content]), 256)
    return F.when(F.col(kind) != "end", F.coalesce(F.concat(F.lit("p"), F.col(page).cast("string")), told))


def _processor() -> StatefulProcessor:
    # a class made here travels to the workers by value

    class Fetches(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.pages = handle.getMapState("pages", "page string", "file string")
            self.about = handle.getValueState("about", "pages long, expected long, ended boolean, timer long")

        def _told(self, key, state: str, about, timer: int | None) -> Row:
            files = sorted({v[0] for v in self.pages.values()})
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.pages.clear()
            self.about.clear()
            return Row(fetch=key[0], state=state, pages=about[0], expected=about[1], files=files)

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            pages, expected, ended, timer = self.about.get() if self.about.exists() else (0, None, False, None)
            last = timer or 0
            for r in rows:
                last = max(last, int(r.landed.timestamp() * 1000))
                if r.kind == "end":
                    ended, expected = True, r.expected if r.expected is not None else expected
                elif not self.pages.containsKey((r.page,)):
                    self.pages.updateValue((r.page,), (r.file,))
                    pages += 1
            if ended and (expected is None or pages >= expected):
                yield self._told(key, "complete", (pages, expected), timer)
                return
            if timer is not None:
                self.handle.deleteTimer(timer)
            # the watermark passes the last page once a file lands that is timeout_ms younger
            self.handle.registerTimer(last)
            self.about.update((pages, expected, ended, last))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            if self.about.exists():
                pages, expected, _, _ = self.about.get()
                yield self._told(key, "expired", (pages, expected), None)

        def close(self) -> None:
            pass

    return Fetches()


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed timers need (it spills to the executors' disks and is saved in the checkpoint)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track_fetches(pages: DataFrame, timeout_ms: int = DEFAULT_TIMEOUT_MS) -> DataFrame:
    """Fetches that are complete or expired, from a stream of (fetch, kind, page, file, landed, expected)."""
    use_state_store(pages.sparkSession)
    return (pages.select("fetch", "kind", "page", "file", "landed", F.col("expected").cast("long").alias("expected"))
            .withWatermark("landed", f"{timeout_ms} milliseconds")
            .groupBy("fetch").transformWithState(_processor(), FETCHES, "Append", "EventTime"))

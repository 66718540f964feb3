"""The scan loop as a stream of two inputs, sightings and fetched pages, over keyed state.

A micro-batch may hold parts of scans, scans that returned nothing, and rows that come later than those of newer scans. The last
OPEN scans of each listing stay open: the state is the fold of all older ones beside the merged rows of these, and whoever reads it folds the
open ones on. So the order in which the rows of an open scan arrive, the batches they arrive in, and when its pages are
known do not matter. Rows of older scans are kept apart in ``late``. Scans that miss a listing write nothing to it: the scan log tells
on reading. An alert is judged in the batches that touch its listing, by the pages known then.

Folders under ``root``: ``state`` (see ``KeyedState``), ``scans/v=N`` (facts about scans), ``alerts/v=N`` and ``late/v=N``. A batch that is
run again rewrites its own version from the same input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from pricelens.operators import alerts as al
from pricelens.operators import history as hi
from pricelens.operators import reviews as rv
from pricelens.operators.merging import BY_LISTING, merge_judged, merge_scan
from pricelens.operators.scans import SCAN, scan_facts, scan_log_of
from pricelens.operators.scoring import score, with_prices
from pricelens.streaming.keyed_state import FAN, KeyedState

KEY = hi.KEY
OPEN = 3
#: Kinds of rows in the joined stream.
SIGHTING, PAGE = "sighting", "page"


def joined_stream(sightings: DataFrame, pages: DataFrame) -> DataFrame:
    """Both inputs as one frame, streaming or not, told apart by ``kind``; columns that one of them lacks are null."""
    return sightings.withColumn("kind", F.lit(SIGHTING)).unionByName(pages.withColumn("kind", F.lit(PAGE)), allowMissingColumns=True)


@dataclass(frozen=True)
class ScanStream:
    """What a batch needs besides its rows.

    ``observations`` turns the batch's sightings into observation rows and ``pages`` its pages into (watch, source, scan_id, page_no, max_pages,
    http_status, parsed, items). ``reviews`` are review events; one counts from the scan that ``review_scan`` names on. ``columns`` are the facts of a
    sighting that readers of the state read, besides what the timeline and alerts need: sightings are judged first then and merged, kept open and
    stored with these alone, and none of watches that are not configured. All facts, judged whenever they are read, if not given.
    """

    root: str
    watches: DataFrame
    observations: Callable[[DataFrame], DataFrame]
    pages: Callable[[DataFrame], DataFrame]
    reviews: DataFrame | None = None
    review_scan: Column | None = None
    gone_after: int = hi.GONE_AFTER
    open_scans: int = OPEN
    fan: int = FAN
    columns: Sequence[str] | None = None

    @property
    def state(self) -> KeyedState:
        return KeyedState(f"{self.root}/state", KEY, self.fan)

    def path(self, table: str, version: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if version is None else f"/v={version}")

    def scan_log(self, spark: SparkSession, version: int) -> DataFrame:
        return scan_log_of(spark.read.parquet(self.path("scans")).where(F.col("v") <= version))

    def process(self, batch: DataFrame, version: int) -> None:
        """One micro-batch: facts about its scans, then the listings it touched."""
        spark = batch.sparkSession
        batch = batch.persist()
        seen = with_prices(self.observations(batch.where(F.col("kind") == SIGHTING)))
        fresh = self._merged(seen).persist()
        try:
            # judging drops sightings of watches that are not configured; there was a scan all the same
            scan_facts(self.pages(batch.where(F.col("kind") == PAGE)), fresh if self.columns is None else seen).write.mode("overwrite").parquet(self.path("scans", version))
            self._advance(spark, fresh, self.scan_log(spark, version).persist(), version)
        finally:
            fresh.unpersist()
            batch.unpersist()

    def _advance(self, spark: SparkSession, fresh: DataFrame, scans: DataFrame, version: int) -> None:
        base, rows, held = None, fresh, []
        if version:
            before = self.state.read(spark, version - 1, fresh).select(*KEY, "base", "open").persist()
            base = before.where(F.col("base").isNotNull()).select(*KEY, "base.*")
            ends = base.select(*KEY, F.col("last_scan_id").alias("closed_scan"))
            rows = merge_scan(fresh.unionByName(before.select(*KEY, F.inline("open")))).join(ends, KEY, "left").persist()
            held = [before, rows]
            is_late = F.coalesce(F.col("scan_id") <= F.col("closed_scan"), F.lit(False))
            rows.where(is_late).drop("closed_scan").write.mode("overwrite").parquet(self.path("late", version))
            rows = rows.where(~is_late).drop("closed_scan")
        lines = self._lines(rows, base, scans, None if self.reviews is None else self.reviews.join(fresh.select(*KEY).distinct(), KEY, "left_semi"))
        newest = Window.partitionBy(*BY_LISTING).orderBy(F.desc("scan_id"))
        lines = lines.withColumn("back", F.row_number().over(newest)).persist()
        raw = [c for c in fresh.columns if c not in KEY]
        still_open = rows.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= self.open_scans).groupBy(*KEY).agg(
            F.collect_list(F.struct(*raw)).alias("open"))
        closed = hi.snapshot(lines.where(F.col("carried") | (F.col("back") > self.open_scans)).drop("back"), scans, True, self.gone_after)
        closed = closed.drop("alerts", "missed_scans", "status")
        closed = closed.select(*KEY, F.struct(*[c for c in closed.columns if c not in KEY]).alias("base"))
        self.state.write(still_open.join(closed, KEY, "left"), version)
        # one row for each scan that was judged, so that a later version of it can take an alert back
        told = al.alert_rows(al.fold_alerts(lines))
        lines.where(~F.col("carried")).select(*KEY, "scan_id").join(told, [*KEY, "scan_id"], "left").write.mode("overwrite").parquet(self.path("alerts", version))
        for kept in (*held, lines, scans):
            kept.unpersist()

    def _merged(self, seen: DataFrame) -> DataFrame:
        return merge_scan(seen) if self.columns is None else merge_judged(score(seen, self.watches), [c for c in self.columns if c not in hi.SETTINGS])

    def _lines(self, rows: DataFrame, base: DataFrame | None, scans: DataFrame, reviews: DataFrame | None) -> DataFrame:
        if self.columns is None:
            lines = hi.timeline(hi.lean(score(rows, self.watches)), scans, base, self.gone_after)
        else:
            lines = hi.with_settings(hi.timeline(rows, scans, base, self.gone_after), self.watches)
        return lines if reviews is None else rv.review_at_scan(lines, reviews, self.review_scan)

    def current_state(self, spark: SparkSession, version: int) -> DataFrame:
        """Every listing after ``version``: its open scans folded onto its state before them, as the scan log stands."""
        state, scans = self.state.read(spark, version), self.scan_log(spark, version)
        base = state.where(F.col("base").isNotNull()).select(*KEY, "base.*")
        lines = self._lines(state.select(*KEY, F.inline("open")), base, scans, self.reviews)
        return hi.snapshot(lines, scans, True, self.gone_after).drop("alerts")

    def alerts(self, spark: SparkSession, version: int) -> DataFrame:
        """All alerts of closed scans after ``version``, as last judged. An open scan may still change its mind."""
        told = spark.read.parquet(self.path("alerts")).where(F.col("v") <= version)
        rest = [c for c in told.columns if c not in (*KEY, "scan_id", "v")]
        newest = told.groupBy(*KEY, "scan_id").agg(F.max_by(F.struct(*rest), "v").alias("row")).select(*KEY, "scan_id", "row.*")
        done = self.scan_log(spark, version).where("closed").select(*SCAN)
        return newest.where(F.col("event").isNotNull()).join(done, SCAN, "left_semi")

    def released(self, spark: SparkSession, version: int) -> DataFrame:
        """Alerts to be pushed after ``version``: those that were not among the alerts of the version before."""
        now = self.alerts(spark, version)
        return now if version == 0 else now.join(self.alerts(spark, version - 1), [*KEY, "scan_id"], "left_anti")


def run_stream(stream: DataFrame, job: ScanStream, checkpoint: str) -> StreamingQuery:
    """Process everything there is, in micro-batches, and stop. Use a processing-time trigger for a standing job."""
    started = stream.writeStream.foreachBatch(job.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return started

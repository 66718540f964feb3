"""The scan loop as a stream: every micro-batch of whole scans advances the listing snapshot.

Folders under ``root``: ``state/v=N``, ``history/v=N``, ``alerts/v=N`` and ``scans/v=N``, one version per micro-batch.
A batch reads version N-1 and writes version N, so a batch that is run again after a failure rewrites the same
version from the same input: the result does not depend on how often a batch was tried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pricelens.operators import history as hi
from pricelens.operators.market import MARKET_NAMES, market_table, snapshot_points
from pricelens.operators.merging import merge_judged, merge_scan
from pricelens.operators.scans import SCAN
from pricelens.operators.scoring import score, with_prices

#: What the history holds of a price point besides its keys: what every sighting has, and facts.
SIGHTED, POINT_COLS = ("obs_id", "seen_at", "delivered_cents", "unit_cents"), ("price_cents", "model", "family")


@dataclass(frozen=True)
class StateStream:
    """What a batch needs besides its rows.

    ``observations`` turns the raw micro-batch into observation rows, ``complete`` tells whole scans from cut ones.
    With ``market_days`` set, a batch is judged against the market as it stood before it. ``columns`` are the facts of a sighting that readers
    of the state read, besides what the timeline and alerts need: sightings are judged first then and merged, kept and stored with these alone. All facts if not given.
    """

    root: str
    watches: DataFrame
    observations: Callable[[DataFrame], DataFrame]
    complete: Column
    gone_after: int = hi.GONE_AFTER
    market_days: int | None = None
    columns: Sequence[str] | None = None

    def path(self, table: str, version: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if version is None else f"/v={version}")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = with_prices(self.observations(batch))
        seen.select(*SCAN).distinct().write.mode("overwrite").parquet(self.path("scans", batch_id))
        scans = hi.scan_log(spark.read.parquet(self.path("scans")).where(F.col("v") <= batch_id), self.complete)
        previous = spark.read.parquet(self.path("state", batch_id - 1)) if batch_id else None
        market = None
        if self.market_days is not None and batch_id:
            as_of = seen.agg(F.min("scan_id").cast("timestamp")).scalar()
            market = market_table(snapshot_points(previous, as_of, self.market_days))
        if self.columns is None:
            lines = hi.timeline(hi.lean(score(merge_scan(seen), self.watches, market)), scans, previous, self.gone_after)
        else:
            judged = score(seen, self.watches, market)
            names = [*self.columns, *POINT_COLS, *[c for c in MARKET_NAMES if c in judged.columns]]
            rows = merge_judged(judged, [c for c in names if c not in hi.SETTINGS])
            lines = hi.with_settings(hi.timeline(rows, scans, previous, self.gone_after), self.watches)
        lines = lines.persist()
        try:
            state = hi.snapshot(lines, scans, True, self.gone_after)
            state.write.mode("overwrite").partitionBy("watch").parquet(self.path("state", batch_id))
            points = hi.price_history(lines).select(*hi.KEY, "scan_id", *SIGHTED, *POINT_COLS)
            points.write.mode("overwrite").parquet(self.path("history", batch_id))
        finally:
            lines.unpersist()
        written = spark.read.parquet(self.path("state", batch_id))
        written.select(*hi.KEY, F.inline("alerts")).write.mode("overwrite").parquet(self.path("alerts", batch_id))


def run_available(stream: DataFrame, job: StateStream, checkpoint: str) -> StreamingQuery:
    """Process everything there is, in micro-batches, and stop. Use a processing-time trigger for a standing job."""
    started = (stream.writeStream.foreachBatch(job.process).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    started.awaitTermination()
    return started


def last_version(spark: SparkSession, job: StateStream, query: StreamingQuery) -> DataFrame:
    """Snapshot after the last micro-batch of a finished query."""
    return spark.read.parquet(job.path("state", query.lastProgress["batchId"]))

"""Scans of single days with a log of what was fetched, in one batch and as a stream of several.

Every order stands for a page that was fetched and held no listing, so many whole scans return nothing; every day with sightings for
a page that held some. The stream gets the line items in four arrivals whose bounds cut through scans: a row comes up to two days after those of its
day, so rows of older scans follow rows of newer ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators import history as hi
from pricelens.operators import reviews as rv
from pricelens.operators.scans import SCAN, scan_facts, scan_log_of
from pricelens.operators.scoring import score, with_prices
from pricelens.plans import frames as fr
from pricelens.plans.listing_queries import STATE_OUT, state_columns
from pricelens.plans.oracle import CTES, compose
from pricelens.plans.registry import query
from pricelens.plans.report_queries import review_events
from pricelens.session import shared_folder, stored
from pricelens.sources.observations import observation_log, source_name, table
from pricelens.streaming.scan_stream import ScanStream, joined_stream, run_stream

KEY = ["watch", "source", "listing_id"]
NAMES = ("PROMO", "SMALL", "ECONOMY", "LARGE", "STANDARD", "MEDIUM")
ARRIVALS, DAYS, START = 4, 630, "1995-01-01"
PAGE = ["page_no", "max_pages", "http_status", "parsed", "items"]

_NAMES_SQL = "CASE o_custkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
SWAP = {
    "obs": CTES["obs"].replace("CAST(date_trunc('month', l.l_shipdate) AS DATE)", "CAST(l.l_shipdate AS DATE)"),
    "scans": f"""
      SELECT *, row_number() OVER (PARTITION BY watch, source ORDER BY scan_id) AS scan_no,
        CAST(sum(CASE WHEN complete THEN 1 ELSE 0 END) OVER (PARTITION BY watch, source ORDER BY scan_id) AS BIGINT) AS thru
      FROM (SELECT watch, source, scan_id, bool_and(whole) AS complete FROM (
          SELECT DISTINCT watch, source, scan_id, TRUE AS whole FROM obs UNION ALL
          SELECT watch, source, scan_id, status <> 'P' AND source NOT IN ('vinted', 'hfr') FROM (
            SELECT {_NAMES_SQL} AS watch, CASE o_orderkey % 4 WHEN 0 THEN 'lbc' WHEN 1 THEN 'ebay' WHEN 2 THEN 'vinted' ELSE 'hfr' END AS source,
              CAST(o_orderdate AS DATE) AS scan_id, o_orderstatus AS status FROM orders)) GROUP BY ALL)""",
}


def daily(df: DataFrame) -> DataFrame:
    return df.withColumn("scan_id", F.to_date("seen_at"))


def _page(df: DataFrame, status, items: int) -> DataFrame:
    return df.select(*SCAN, F.lit(1).cast("bigint").alias("page_no"), F.lit(1).cast("bigint").alias("max_pages"), status.cast("bigint").alias("http_status"),
                     F.lit(True).alias("parsed"), F.lit(items).cast("bigint").alias("items"))


def fetched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with listings, one for each day with sightings, and pages without, one for each order."""
    orders = table(spark, sf, "orders")
    empty = orders.select(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_custkey") % 6 + 1).cast("int")).alias("watch"),
                          source_name(F.col("o_orderkey")).alias("source"), F.to_date("o_orderdate").alias("scan_id"), "o_orderstatus")
    full = daily(observation_log(spark, sf)).select(*SCAN).distinct()
    return _page(full, F.lit(200), 1).unionByName(_page(empty, F.when(F.col("o_orderstatus") == "P", 503).otherwise(200), 0))


def daily_scans(spark: SparkSession, sf: str) -> DataFrame:
    return scan_log_of(scan_facts(fetched_pages(spark, sf)))


def daily_lines(spark: SparkSession, sf: str, columns: Sequence[str] = ()) -> DataFrame:
    rows = fr.merged_rows(score(with_prices(daily(observation_log(spark, sf))), fr.watches(spark)), columns)
    return hi.timeline(rows, daily_scans(spark, sf))


@query("scan_log", compose("SELECT watch, source, strftime(scan_id, '%Y-%m-%d') AS scan, complete, CAST(scan_no AS BIGINT) AS scan_no, thru AS complete_through "
                           "FROM scans", "scans", swap=SWAP))
def scan_log(spark, sf):
    return daily_scans(spark, sf).select("watch", "source", fr.text(F.col("scan_id")).alias("scan"), "complete", F.col("scan_no").cast("bigint").alias("scan_no"),
                                         F.col("complete_through").cast("bigint").alias("complete_through"))


@query("missed_fetched_scans", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, after AS missed_after, "
    "merged IN ('active', 'pending') AND after >= 2 AS gone FROM (SELECT f.*, coalesce(lead(thru - CAST(complete AS INTEGER)) OVER (PARTITION BY f.watch, "
    "f.source, listing_id ORDER BY scan_id), total) - thru AS after FROM fold f JOIN (SELECT watch, source, max(thru) AS total FROM scans GROUP BY ALL) t "
    "ON t.watch = f.watch AND t.source = f.source)", "fold", "scans", swap=SWAP))
def missed_fetched_scans(spark, sf):
    """Whole scans missed after each sighting; most of them returned nothing at all."""
    df = hi.missed_scan_runs(daily_lines(spark, sf), daily_scans(spark, sf))
    return df.select(*KEY, fr.text(F.col("scan_id")).alias("scan"), F.col("missed_after").cast("bigint").alias("missed_after"), "gone")


@query("fetched_state", compose(f"SELECT {STATE_OUT} FROM state", "state", swap=SWAP))
def fetched_state(spark, sf):
    """The state of the same scans in one batch."""
    return state_columns(hi.snapshot(daily_lines(spark, sf, fr.SHOWN), daily_scans(spark, sf), True))


def arrival(day: Column) -> Column:
    return F.least(F.floor(F.datediff(day, F.lit(START).cast("date")) / DAYS), F.lit(ARRIVALS - 1)).cast("int")


def job_for(spark, sf, root, reviews=None) -> ScanStream:
    return ScanStream(root, fr.watches(spark), lambda batch: daily(observation_log(batch.sparkSession, sf, batch)), lambda batch: batch.select(*SCAN, *PAGE),
                      reviews, F.date_add(F.to_date("ts"), 1), columns=fr.SHOWN)


def streamed(spark: SparkSession, sf: str, reviews: DataFrame | None = None) -> tuple[ScanStream, int]:
    """Runs the stream over four arrivals, each written to the stream's input folder and processed before the next one comes."""
    job = job_for(spark, sf, shared_folder(spark, "scan-stream"), reviews)
    folder, checkpoint = shared_folder(spark, "arrivals"), shared_folder(spark, "scan-stream-checkpoint")
    lines = table(spark, sf, "lineitem")
    lines = lines.withColumn("arrival", arrival(F.date_add(F.to_date("l_shipdate"), (F.col("l_linenumber") % 3).cast("int"))))
    pages = fetched_pages(spark, sf).withColumn("arrival", arrival(F.col("scan_id")))
    every = stored(joined_stream(lines, pages), "captured")
    for n in range(ARRIVALS):
        every.where(F.col("arrival") == n).drop("arrival").write.mode("append").parquet(folder)
        done = run_stream(spark.readStream.schema(every.drop("arrival").schema).parquet(folder), job, checkpoint)
    return job, done.lastProgress["batchId"]


@query("scan_stream_state", compose(f"SELECT {STATE_OUT} FROM state", "state", swap=SWAP))
def scan_stream_state(spark, sf):
    """The state after four micro-batches that share scans; the stream runs when the frame is made."""
    job, version = streamed(spark, sf)
    return state_columns(job.current_state(spark, version))


@query("scan_stream_alerts", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, alert AS event, unit_cents, prev_notified AS prev_cents FROM foldr WHERE alert IS NOT NULL",
    "foldr", swap=SWAP))
def scan_stream_alerts(spark, sf):
    """Alerts of the same stream with the reviews that were in force; ignored listings never alert. The stream runs when the frame is made."""
    job, version = streamed(spark, sf, review_events(spark, sf))
    return job.alerts(spark, version).select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "event", "unit_cents", "prev_cents")

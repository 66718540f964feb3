"""Streamed runs over the line items; their results must equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.plans import frames as fr
from pricelens.plans.listing_queries import STATE_OUT, state_columns
from pricelens.plans.oracle import compose
from pricelens.plans.registry import query
from pricelens.session import shared_folder
from pricelens.sources.observations import observation_log, scan_is_complete, table
from pricelens.streaming.state_stream import StateStream, run_available

KEY = ["watch", "source", "listing_id"]


def job_for(spark, sf, root):
    return StateStream(root, fr.watches(spark), lambda batch: observation_log(batch.sparkSession, sf, batch),
                       scan_is_complete(F.col("scan_id"), F.col("source")), columns=fr.SHOWN)


def line_stream(spark, folder, schema, pattern="*.parquet", per_batch=None):
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def streamed(spark, sf):
    job = job_for(spark, sf, shared_folder(spark, "stream"))
    stream = line_stream(spark, sf, table(spark, sf, "lineitem").schema, "lineitem.parquet")
    done = run_available(stream, job, shared_folder(spark, "stream-checkpoint"))
    return job, done.lastProgress["batchId"]


@query("stream_state_merge", compose(f"SELECT {STATE_OUT} FROM state", "state"))
def stream_state_merge(spark, sf):
    job, version = streamed(spark, sf)
    return state_columns(spark.read.parquet(job.path("state", version)))


@query("gone_stream", compose("SELECT watch, source, listing_id, CAST(missed_scans AS BIGINT) AS missed_scans FROM state WHERE status = 'gone'", "state"))
def gone_stream(spark, sf):
    job, version = streamed(spark, sf)
    return spark.read.parquet(job.path("state", version)).where(F.col("status") == "gone").select(*KEY, "missed_scans")


@query("alert_stream_live", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, alert AS event, unit_cents, prev_notified AS prev_cents FROM fold WHERE alert IS NOT NULL",
    "fold"))
def alert_stream_live(spark, sf):
    job, _ = streamed(spark, sf)
    return spark.read.parquet(job.path("alerts")).select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "event", "unit_cents", "prev_cents")

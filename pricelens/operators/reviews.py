"""Review actions of the user laid over listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.operators.merging import BY_LISTING

KEY = ["watch", "source", "listing_id"]
REVIEWS = ("", "starred", "seen", "ignored")


def review_overlay(events: DataFrame) -> DataFrame:
    """Latest review of each listing; a null note keeps the older note, a note is cut at 1000 characters."""
    at = F.struct("ts", "event_id")
    valid = events.where(F.col("review").isin(*REVIEWS))
    noted = F.col("note").isNotNull()
    return valid.groupBy(*KEY).agg(
        F.max_by("review", at).alias("review"),
        F.coalesce(F.max_by(F.when(noted, F.substring("note", 1, 1000)), F.when(noted, at)), F.lit("")).alias("note"))


def with_reviews(listings: DataFrame, overlay: DataFrame) -> DataFrame:
    """Listings with their current review and note, empty when never reviewed."""
    return listings.join(overlay, KEY, "left").withColumn("review", F.coalesce("review", F.lit(""))).withColumn(
        "note", F.coalesce("note", F.lit("")))


def review_at_scan(lines: DataFrame, events: DataFrame, scan_of) -> DataFrame:
    """Sightings with the review in force when their scan started.

    Events are first reduced to the last one per listing and scan interval (``scan_of`` maps an event to the scan
    it precedes), so the window holds at most two rows per listing and scan. These few are dealt by listing, as the sightings
    of a timeline are already, so the union of both needs no shuffle.
    """
    per_scan = events.where(F.col("review").isin(*REVIEWS)).groupBy(*KEY, scan_of.alias("scan_id")).agg(
        F.max_by("review", F.struct("ts", "event_id")).alias("review"))
    marks = per_scan.repartition(*BY_LISTING).withColumn("mark", F.lit(True))
    both = lines.withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*BY_LISTING).orderBy("scan_id", F.col("mark").desc())
    current = F.last("review", ignorenulls=True).over(w)
    return both.withColumn("review", F.coalesce(current, F.lit(""))).where(~F.col("mark")).drop("mark")

"""Frames the registered queries start from, built from the test tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.config import watch_frame
from pricelens.operators import history as hi
from pricelens.operators.history import SETTINGS
from pricelens.operators.merging import merge_judged, merge_scan
from pricelens.operators.profiles import PROFILES
from pricelens.operators.scoring import score, with_prices
from pricelens.plans.settings import WATCHES
from pricelens.session import shared_folder
from pricelens.sources.observations import observation_log, scan_is_complete, source_name, dealt, table
from pricelens.sources.sinks import sink_state


def month_of(shipped: Column) -> Column:
    return F.trunc(F.to_date(shipped), "month")


def text(col: Column) -> Column:
    """Dates as text, arrays as one joined text: the same value in every engine."""
    return F.date_format(col, "yyyy-MM-dd")


def joined(col: Column) -> Column:
    return F.array_join(col, "|")


def watches(spark: SparkSession) -> DataFrame:
    return watch_frame(spark, WATCHES, PROFILES)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return with_prices(observation_log(spark, sf))


#: What deciding on alerts needs, what states show of a listing, and what the market needs.
ALERTING = ("enabled", "keep", "suspicious", "suspicious_mode", "price_drop_pct")
SHOWN = ("tier", *ALERTING)
MARKET = ("keep", "quantity", "suspicious", "model", "family")


def merged_rows(judged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per listing and scan of judged sightings, with the named columns alone (see ``merging.merge_judged``)."""
    return merge_judged(judged, columns)


def scored_scan_rows(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One scored row per listing and scan, judged against the reference price (an empty market); with ``columns``, only with these of its facts."""
    if columns is None:
        return score(merge_scan(log(spark, sf)), watches(spark))
    return merged_rows(score(log(spark, sf), watches(spark)), columns)


def scans_touched(spark: SparkSession, sf: str, sightings: DataFrame, scan_of=month_of) -> DataFrame:
    """All line items of the listings' scans that ``sightings`` (source, listing_id, scan_id) names."""
    line = dealt(table(spark, sf, "lineitem"))
    s = sightings.select("source", "listing_id", "scan_id").distinct()
    return line.join(s, (line.l_partkey.cast("string") == s.listing_id) & (source_name(line.l_suppkey) == s.source)
                     & (scan_of(line.l_shipdate) == s.scan_id), "left_semi")


def facts_of(spark: SparkSession, sf: str, sightings: DataFrame) -> DataFrame:
    """All facts of the merged, scored rows of the named sightings; other sightings are not carried along."""
    return score(merge_scan(with_prices(observation_log(spark, sf, scans_touched(spark, sf, sightings)))), watches(spark))


def scans(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(
        "l_partkey", source_name(F.col("l_suppkey")).alias("source"), F.trunc(F.to_date("l_shipdate"), "month").alias("scan_id"))
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    keys = line.join(part, line.l_partkey == part.p_partkey).select(F.col("p_type").alias("watch"), "source", "scan_id")
    return hi.scan_log(keys, scan_is_complete(F.col("scan_id"), F.col("source")))


def lines(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    settings = [c for c in SETTINGS if c in (columns or ())]
    found = hi.timeline(scored_scan_rows(spark, sf, columns and [c for c in columns if c not in settings]), scans(spark, sf))
    return F.broadcast(watches(spark).select("watch", *settings)).join(found, "watch").select(*found.columns, *settings) if settings else found


def history(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    return hi.price_history(lines(spark, sf, columns))


def big(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, dealt out over the cores."""
    return dealt(table(spark, sf, name))


def stored_state(spark: SparkSession, sf: str, columns: Sequence[str] = ()) -> DataFrame:
    """The snapshot as reports read it: a written table, computed once however often a report uses it. ``columns`` are the facts that the report reads."""
    path = shared_folder(spark, "state")
    sink_state(state(spark, sf, columns=(*SHOWN, *columns)), path)
    return spark.read.parquet(path)


def state(spark: SparkSession, sf: str, with_alerts: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    return hi.snapshot(lines(spark, sf, columns), scans(spark, sf), with_alerts)

"""Flagship plan: observation log -> scan merge -> state -> market -> scored current listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.operators import history as hi
from pricelens.operators import market as mk
from pricelens.operators.scoring import with_scam_flags
from pricelens.plans import frames as fr


def scored_listings(spark: SparkSession, sf: str, as_of: str = "2001-11-05", days: int = 400) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    timeline, scans = fr.lines(spark, sf), fr.scans(spark, sf)
    state = hi.snapshot(timeline, scans, False)
    market = mk.market_table(mk.snapshot_points(state, F.lit(as_of).cast("timestamp"), days))
    rules = fr.watches(spark)
    judged = with_scam_flags(mk.attach_market(
        state.drop("suspicious").join(F.broadcast(rules), "watch"),
        market))
    return judged.select("watch", "source", "listing_id", "family", "model", "unit_cents", "status", "tier", "priority",
                         "keep", "median_cents", "median_samples", fr.joined(F.col("suspicious")).alias("suspicious"))

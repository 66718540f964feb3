"""Market medians over the latest price point of each listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["watch", "source", "listing_id"]


def latest_points(history: DataFrame) -> DataFrame:
    """Newest price point of each listing, as a partial aggregate: a hot listing never fills one task."""
    rest = [c for c in history.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct("seen_at", "obs_id")).alias("p")
    return history.groupBy(*KEY).agg(newest).select(*KEY, "p.*")


def medians(points: DataFrame, keys: list[str], value: str = "unit_cents") -> DataFrame:
    """Exact median per key. Equal prices are counted before the shuffle, so a group's state is bounded by
    its number of distinct prices and not by its number of listings."""
    counted = points.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(
        F.percentile(F.col(value), F.lit(0.5), F.col("n")).alias("median_cents"),
        F.sum("n").alias("median_samples"),
    )


def market_points(history: DataFrame, state: DataFrame, as_of: Column, history_days: Column | int = 30) -> DataFrame:
    """Points that make the market: the latest of each listing, recent enough, of a listing that is now kept,
    single and not suspicious. Model and family are those of the point; the status does not matter."""
    current = state.where(F.col("keep") & (F.col("quantity") == 1) & (F.size("suspicious") == 0)).select(*KEY)
    days = history_days if isinstance(history_days, Column) else F.lit(history_days)
    recent = latest_points(history).where(
        F.col("seen_at") >= as_of - F.make_dt_interval(days.cast("int"))).where(F.col("unit_cents") != 0)
    return recent.join(current, KEY, "left_semi")


def snapshot_points(state: DataFrame, as_of: Column, history_days: int = 30) -> DataFrame:
    """``market_points`` out of a snapshot alone: it keeps each listing's latest price point beside its current row,
    so neither the history nor a join is needed."""
    point = F.col("last_point")
    return state.where(
        F.col("keep") & (F.col("quantity") == 1) & (F.size("suspicious") == 0) & (point["unit_cents"] != 0)
        & (point["seen_at"] >= as_of - F.make_dt_interval(F.lit(history_days)))
    ).select("watch", "source", "listing_id", "last_point.*")


#: Names under which a price point counts in the market, fine and broad, where rows have them (``profiles.with_market_names``); else model and family.
MARKET_NAMES = ["market_fine", "market_broad"]


def _names(point: Column | None, known: bool) -> list[Column]:
    return [F.col(n) if point is None else point[n] for n in (MARKET_NAMES if known else ("model", "family"))]


def levels(point: Column | None = None, known: bool = False) -> Column:
    """The names under which a price point counts, finest first. ``known`` tells that the point has the names its profile gives."""
    fine, broad = _names(point, known)
    return F.array(F.struct(F.lit("model").alias("level"), fine.alias("name")), F.struct(F.lit("family").alias("level"), broad.alias("name")))


def market_table(points: DataFrame) -> DataFrame:
    """Medians by model and by family in one frame: (watch, level, name, median_cents, median_samples).

    Points with ``market_fine`` and ``market_broad`` count under these names (see ``profiles.with_market_names``)."""
    known = set(MARKET_NAMES) <= set(points.columns)
    named = points.select("watch", "unit_cents", F.inline(levels(known=known))).where(F.col("name") != "")
    return medians(named, ["watch", "level", "name"])


def attach_market(df: DataFrame, market: DataFrame) -> DataFrame:
    """Add the median for each row: by its fine name, or by its broad name only when the fine one has no point at all."""
    fine_name, broad_name = _names(None, set(MARKET_NAMES) <= set(df.columns))
    fine = market.where(F.col("level") == "model").select(
        "watch", F.col("name").alias("m_name"), F.col("median_cents").alias("m_med"), F.col("median_samples").alias("m_n"))
    broad = market.where(F.col("level") == "family").select(
        "watch", F.col("name").alias("f_name"), F.col("median_cents").alias("f_med"), F.col("median_samples").alias("f_n"))
    named = df.withColumns({"m_name": fine_name, "f_name": broad_name})
    return named.join(fine, ["watch", "m_name"], "left").join(broad, ["watch", "f_name"], "left").withColumn(
        "median_cents", F.when(F.col("m_n").isNotNull(), F.col("m_med")).otherwise(F.col("f_med"))
    ).withColumn("median_samples", F.coalesce("m_n", "f_n", F.lit(0))).drop("m_name", "f_name", "m_med", "m_n", "f_med", "f_n")


def rolling_market(history: DataFrame, eligible: DataFrame, scan_starts: DataFrame, history_days: int = 30) -> DataFrame:
    """Market as it stood at the start of each scan, for every (watch, family).

    A point counts from the moment it is seen until the listing's next point or until it is ``history_days``
    old. Each validity interval touches at most two buckets of ``history_days`` days, so the interval join is an
    equi-join on (watch, bucket) and no window ever ranges over a whole family. ``eligible`` holds the keys of
    listings that may enter the market, ``scan_starts`` (watch, scan_id, start_at) is the scan log.
    """
    days = int(history_days)
    nxt = F.lead("seen_at").over(Window.partitionBy(*KEY).orderBy("seen_at", "obs_id"))
    cols = [*KEY, "family", "unit_cents", "seen_at"]
    points = history.select(*cols, nxt.alias("next_at")).where((F.col("family") != "") & (F.col("unit_cents") != 0))
    points = points.join(eligible.select(*KEY), KEY, "left_semi")

    def bucket(ts: Column) -> Column:
        return F.call_function("div", F.unix_date(F.to_date(ts)), F.lit(days))

    expires = F.col("seen_at") + F.make_dt_interval(F.lit(days))
    points = points.withColumn("expires_at", expires).withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("seen_at")), bucket(F.least("expires_at", "next_at")))))
    starts = scan_starts.withColumn("bucket", bucket(F.col("start_at")))
    seen = points.join(starts, ["watch", "bucket"]).where(
        (F.col("seen_at") < F.col("start_at"))
        & (F.col("start_at") <= F.col("expires_at"))
        & (F.col("next_at").isNull() | (F.col("next_at") >= F.col("start_at")))
    )
    return medians(seen, ["watch", "scan_id", "family"])

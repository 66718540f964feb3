"""Keyed listing state over scans: sticky statuses, missed scans, price events, snapshots.

Every function expects at most one row per listing and scan (``merging.merge_scan``), so a listing's window holds
at most as many rows as there are scans, whatever the skew of the raw observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.listing import status_rank
from pricelens.operators.market import MARKET_NAMES
from pricelens.operators.merging import BY_LISTING

KEY = ["watch", "source", "listing_id"]
GONE_AFTER = 2

# What a snapshot keeps of the last sighting of a listing.
LAST_SEEN_COLS = ["obs_id", "url", "title", "model", "family", "brand", "verdict", "flags", "price_cents",
                  "shipping_cents", "fees_cents", "delivered_cents", "unit_cents", "quantity", "tier", "priority",
                  "keep", "suspicious", "condition", "seller_name", "seller_rating", "seller_reviews", "location",
                  "delivery", "posted_at", "secure_payment", "shipping_estimated", "seller_type", "description",
                  "reasons", "attrs", "notes", "tags", "review", "note", "enriched"]


#: Settings of the watch that alerts and snapshots read: the same for all its sightings, so they join the timeline instead of being shuffled and sorted with it.
SETTINGS = ("enabled", "suspicious_mode", "price_drop_pct")

# What else of a scored row the timeline, the snapshot and the alerts read.
JUDGED_COLS = [*KEY, "scan_id", "seen_at", "status", "enabled", "suspicious_mode", "price_drop_pct", *MARKET_NAMES]


def lean(rows: DataFrame) -> DataFrame:
    """Scored rows without what only scoring needs: the settings of the watches would else be carried, sorted and kept with every sighting."""
    return rows.select(*[c for c in dict.fromkeys([*JUDGED_COLS, *LAST_SEEN_COLS]) if c in rows.columns])


def with_settings(lines: DataFrame, watches: DataFrame, names: Sequence[str] = SETTINGS) -> DataFrame:
    """Lines with settings of their watch, which take no shuffle; a line of a watch that is not configured any more has none."""
    return lines.join(F.broadcast(watches.select("watch", *names)), "watch", "left")


def with_last_facts(state: DataFrame, facts: DataFrame) -> DataFrame:
    """A snapshot of few columns completed by ``facts`` (KEY, scan_id) of each listing's last sighting, to all that a snapshot keeps of it."""
    known = [c for c in LAST_SEEN_COLS if c in facts.columns]
    return state.drop(*known).join(facts.select(*KEY, F.col("scan_id").alias("last_scan_id"), *known), [*KEY, "last_scan_id"])


def scan_log(observations: DataFrame, complete: Column) -> DataFrame:
    """One row per (watch, source, scan) with its rank and the running count of complete scans.

    Its size is the number of scans, independent of the number of listings.
    """
    scans = observations.select("watch", "source", "scan_id").distinct().withColumn("complete", complete)
    w = Window.partitionBy("watch", "source").orderBy("scan_id")
    return scans.withColumn("scan_no", F.row_number().over(w)).withColumn(
        "complete_through", F.sum(F.col("complete").cast("int")).over(w))


def latest_price_point(history: DataFrame) -> DataFrame:
    from pricelens.operators.market import latest_points

    return latest_points(history)


def timeline(scan_rows: DataFrame, scans: DataFrame, previous: DataFrame | None = None,
             gone_after: int = GONE_AFTER) -> DataFrame:
    """Merged status and price event of every sighting, continuing from a snapshot when one is given.

    Sold never leaves. Pending lasts until the listing goes missing for ``gone_after`` complete scans, which
    makes it gone; a listing seen again after that starts afresh. The last sighting kept in ``previous`` enters
    as a carried row, which is all that is needed to continue from it. The scan log has one row per scan, however many
    listings there are; it goes to the rows, which are shuffled by listing alone.
    """
    rows = scan_rows.withColumn("carried", F.lit(False))
    if previous is not None:
        kept = previous.select(*KEY, *[c for c in LAST_SEEN_COLS if c in previous.columns], F.col("last_scan_id").alias("scan_id"),
                               F.col("last_seen").alias("seen_at"), F.col("seen_status").alias("status"), "first_seen",
                               "notified_cents", "notified_at", "notify_count", "last_point", "price_points", F.lit(True).alias("carried"))
        rows = rows.unionByName(kept, allowMissingColumns=True)
    numbered = rows.join(F.broadcast(scans.select("watch", "source", "scan_id", "complete", "scan_no", "complete_through")),
                         ["watch", "source", "scan_id"])
    w = Window.partitionBy(*BY_LISTING).orderBy("scan_id")
    rank = status_rank(F.col("status"))
    open_rank = F.when(F.col("status") == "gone", F.lit(0)).otherwise(rank)
    missed = F.col("complete_through") - F.col("complete").cast("int") - F.lag("complete_through").over(w)
    df = numbered.withColumn("missed_before", F.coalesce(missed, F.lit(0)))
    # The island number only grows, so the running maximum of island * 4 + rank is the worst rank of the island.
    df = df.withColumn("island", F.sum((F.col("missed_before") >= gone_after).cast("int")).over(w))
    df = df.withColumn("worst", F.max(F.col("island") * 4 + open_rank).over(w) - F.col("island") * 4).withColumn(
        "was_sold", F.max(rank).over(w) == 3)
    df = df.withColumn("merged_status", F.when(F.col("was_sold"), "sold").when(F.col("worst") == 2, "pending")
                       .when(F.col("status") == "gone", "gone").otherwise("active"))
    df = df.withColumn("prev_merged", F.lag("merged_status").over(w)).withColumn(
        "prev_unit_cents", F.lag("unit_cents").over(w))
    went_missing = (F.col("missed_before") >= gone_after) & F.col("prev_merged").isin("active", "pending")
    df = df.withColumn("prev_status", F.when(went_missing, "gone").otherwise(F.col("prev_merged")))
    event = (
        F.when(F.col("prev_merged").isNull(), "new")
        .when(F.col("unit_cents") < F.col("prev_unit_cents"), "price_drop")
        .when(F.col("unit_cents") > F.col("prev_unit_cents"), "price_up")
        .when(F.col("merged_status") != F.col("prev_status"), "status_change")
        .otherwise("unchanged")
    )
    return df.withColumn("event", event).drop("worst", "was_sold", "prev_merged", "island")


def price_events(lines: DataFrame) -> DataFrame:
    """The event of each new sighting."""
    return lines.where(~F.col("carried"))


def is_price_point() -> Column:
    return ~F.col("carried") & F.col("event").isin("new", "price_drop", "price_up")


def price_history(lines: DataFrame) -> DataFrame:
    """Price points: first sightings and price changes only."""
    return lines.where(is_price_point())


def missed_scan_runs(lines: DataFrame, scans: DataFrame, gone_after: int = GONE_AFTER) -> DataFrame:
    """For every sighting: complete scans missed right after it, and whether that made the listing gone."""
    totals = scans.groupBy("watch", "source").agg(F.max("complete_through").alias("total_complete"))
    w = Window.partitionBy(*BY_LISTING).orderBy("scan_id")
    nxt = F.lead(F.col("complete_through") - F.col("complete").cast("int")).over(w)
    df = lines.withColumn("until_next", nxt).join(F.broadcast(totals), ["watch", "source"])
    run = F.coalesce("until_next", "total_complete") - F.col("complete_through")
    counts = F.col("merged_status").isin("active", "pending")
    return df.withColumn("missed_after", run).withColumn(
        "missed_scans", F.when(counts, F.least(run, F.lit(gone_after))).otherwise(F.lit(0))
    ).withColumn("gone", counts & (run >= gone_after))


def _point_of(lines: DataFrame, names: list[str], own: list[str]) -> Column:
    """The carried price point with ``names`` (model, family, as far as sightings have them) and the market names ``own``; one from before rows had
    market names counts by model and family."""
    point, had = F.col("last_point"), lines.select("last_point.*").columns

    def known(name: str) -> Column:
        return point[name] if name in had else F.lit(None).cast("string")

    named = [known(n if n in had else plain).alias(n) for n, plain in zip(MARKET_NAMES, ("model", "family")) if n in own]
    plain = F.struct(*[point[n].alias(n) for n in ("seen_at", "obs_id", "unit_cents")], *[known(n).alias(n) for n in names], *named)
    return F.when(point.isNotNull(), plain)


def snapshot(lines: DataFrame, scans: DataFrame, with_alerts: bool = True, gone_after: int = GONE_AFTER) -> DataFrame:
    """Current row of every listing, with its notification state and the alerts of this timeline.

    Last sighting, first date and alert entries come out of one aggregation that reuses the timeline's partitioning.
    """
    from pricelens.operators.alerts import alert_entry, fold_entries

    totals = scans.groupBy("watch", "source").agg(F.max("complete_through").alias("total_complete"))
    first = F.col("first_seen") if "first_seen" in lines.columns else F.lit(None).cast("timestamp")
    last = F.struct(*[c for c in LAST_SEEN_COLS if c in lines.columns], F.col("scan_id").alias("last_scan_id"), F.col("seen_at").alias("last_seen"),
                    F.col("merged_status").alias("seen_status"), "complete_through")
    own = [n for n in MARKET_NAMES if n in lines.columns]
    names = [n for n in ("model", "family") if n in lines.columns]
    old_point, old_count = (_point_of(lines, names, own), F.col("price_points")) if "last_point" in lines.columns else (None, None)
    fresh = F.when(is_price_point(), F.struct("seen_at", "obs_id", "unit_cents", *names, *own))
    point = fresh if old_point is None else F.coalesce(fresh, old_point)
    count = is_price_point().cast("bigint")
    count = count if old_count is None else F.coalesce(F.when(F.col("carried"), old_count), count)
    aggs = [F.max_by(last, "scan_id").alias("last"), F.min(F.coalesce(first, "seen_at")).alias("first_seen"),
            F.max_by(point, F.struct(point["seen_at"], point["obs_id"])).alias("last_point"), F.sum(count).alias("price_points")]
    if with_alerts:
        aggs.append(F.collect_list(alert_entry(lines)).alias("entries"))
    state = lines.groupBy(*BY_LISTING).agg(*aggs)
    if with_alerts:
        state = state.withColumn("f", fold_entries(F.col("entries"))).select(*KEY, "first_seen", "last_point", "price_points", "last.*", "f.*")
    else:
        state = state.select(*KEY, "first_seen", "last_point", "price_points", "last.*")
    state = state.join(F.broadcast(totals), ["watch", "source"])
    run = F.col("total_complete") - F.col("complete_through")
    counts = F.col("seen_status").isin("active", "pending")
    return state.withColumn(
        "missed_scans", F.when(counts, F.least(run, F.lit(gone_after))).otherwise(F.lit(0)).cast("bigint")
    ).withColumn("status", F.when(counts & (run >= gone_after), "gone").otherwise(F.col("seen_status"))
                 ).drop("total_complete", "complete_through")


def missing_listings(state: DataFrame, scan_rows: DataFrame, scan: DataFrame) -> DataFrame:
    """Open listings that the latest complete scan of their watch and source did not return.

    ``scan`` may hold any number of scans; one row for each watch and source is joined, so no listing is multiplied."""
    done = scan.where("complete").groupBy("watch", "source").agg(F.max("scan_id").alias("scan_id"))
    open_rows = state.where(F.col("status").isin("active", "pending")).join(done, ["watch", "source"])
    return open_rows.join(scan_rows.select(*KEY, "scan_id"), [*KEY, "scan_id"], "left_anti")

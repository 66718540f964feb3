"""Alert decisions against the last notified price, and alert rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.operators.merging import BY_LISTING

KEY = ["watch", "source", "listing_id"]
ALERT_DDL = "scan_id DATE, seen_at TIMESTAMP, event STRING, unit_cents BIGINT, prev_cents BIGINT, suspicious BOOLEAN"


def alert_entry(lines: DataFrame) -> Column:
    """What the fold needs of a sighting; null for one that can neither alert nor carry a start value."""
    review = F.col("review") if "review" in lines.columns else F.lit("")
    carried = "notified_cents" in lines.columns
    suspicious = F.coalesce(F.size("suspicious") > 0, F.lit(False))
    eligible = F.coalesce(
        ~F.col("carried") & F.col("enabled") & F.col("keep") & (F.col("merged_status") == "active")
        & (F.coalesce(review, F.lit("")) != "ignored") & ~(suspicious & (F.col("suspicious_mode") == "never")),
        F.lit(False))
    null_long, null_ts, zero = F.lit(None).cast("bigint"), F.lit(None).cast("timestamp"), F.lit(0).cast("bigint")
    entry = F.struct(
        "scan_id", "seen_at", eligible.alias("eligible"), "unit_cents", suspicious.alias("suspicious"),
        F.col("price_drop_pct").alias("pct"),
        (F.col("notified_cents") if carried else null_long).alias("notified_cents"),
        (F.col("notified_at") if carried else null_ts).alias("notified_at"),
        (F.coalesce("notify_count", zero) if carried else zero).alias("notify_count"),
    )
    return F.when(eligible | F.col("carried"), entry)


def fold_entries(seen: Column) -> Column:
    """Fold the entries of one listing, in scan order, to its notification state and alerts.

    A sighting alerts as ``new`` while the listing was never notified and as ``price_drop`` once its unit price is
    at or under the last *notified* price less the watch's percentage. A carried entry only sets the start value.
    The array holds at most one entry per scan, so it is bounded by the number of scans.
    """
    start = F.struct(F.lit(None).cast("bigint").alias("notified_cents"), F.lit(None).cast("timestamp").alias("notified_at"),
                     F.lit(0).cast("bigint").alias("notify_count"),
                     F.from_json(F.lit("[]"), f"ARRAY<STRUCT<{ALERT_DDL}>>").alias("alerts"))

    def step(acc: Column, row: Column) -> Column:
        event = F.when(~row["eligible"], F.lit(None).cast("string")).when(
            acc["notified_cents"].isNull(), F.lit("new")).when(
            row["unit_cents"] * 100 <= acc["notified_cents"] * (100 - row["pct"]), F.lit("price_drop"))
        alert = F.struct(row["scan_id"].alias("scan_id"), row["seen_at"].alias("seen_at"), event.alias("event"),
                         row["unit_cents"].alias("unit_cents"), acc["notified_cents"].alias("prev_cents"),
                         row["suspicious"].alias("suspicious"))
        fire = event.isNotNull()
        return F.struct(
            F.when(fire, row["unit_cents"]).otherwise(F.coalesce(row["notified_cents"], acc["notified_cents"]))
            .alias("notified_cents"),
            F.when(fire, row["seen_at"]).otherwise(F.coalesce(row["notified_at"], acc["notified_at"]))
            .alias("notified_at"),
            (acc["notify_count"] + row["notify_count"] + fire.cast("bigint")).alias("notify_count"),
            F.when(fire, F.concat(acc["alerts"], F.array(alert))).otherwise(acc["alerts"]).alias("alerts"),
        )

    return F.aggregate(F.sort_array(seen), start, step)


def fold_alerts(lines: DataFrame) -> DataFrame:
    """Notification state and alerts of every listing that has something to fold."""
    entries = lines.withColumn("entry", alert_entry(lines)).where(F.col("entry").isNotNull())
    folded = entries.groupBy(*BY_LISTING).agg(F.collect_list("entry").alias("seen"))
    return folded.select(*KEY, fold_entries(F.col("seen")).alias("f")).select(*KEY, "f.*")


def alert_rows(folded: DataFrame) -> DataFrame:
    """One row per alert."""
    return folded.select(*KEY, F.inline("alerts"))


def alert_messages(alerts: DataFrame, lines: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Each alert as a row ready to be pushed: title, body, priority 1-5, tags, click URL.

    Rows with ``attrs`` get a line for each attribute that their profile labels (``attr_labels`` of the watch)."""
    from pricelens.functions import messages as ms

    facts = lines.where(~F.col("carried")).drop("event", "seen_at", "unit_cents")
    for name, kind in (("stock", "bigint"), ("returns", "string"), ("seller_type", "string")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    rows = alerts.drop("suspicious").join(facts, [*KEY, "scan_id"])
    extra = ms.attribute_lines(F.col("attrs"), F.col("attr_labels")) if {"attrs", "attr_labels"} <= set(rows.columns) else None
    return rows.select(
        *KEY, "scan_id", "event", ms.alert_title(labels).alias("title"), ms.alert_body(extra).alias("message"),
        ms.alert_priority().alias("priority"), ms.alert_tags().alias("tags"), F.col("url").alias("click"))

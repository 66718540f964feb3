"""Watch configuration held as tables: root defaults, watch sections, source sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_watch_sections(root: DataFrame, watches: DataFrame, settings: list[str]) -> DataFrame:
    """Enabled watches with every null setting taken from the root row. Settings fall back one by one, except
    ``thresholds``, which a watch replaces as a whole. ``root`` has one row (read as a scalar subquery)."""
    default = root.agg(F.first(F.struct(*settings)).alias("d")).scalar()
    live = watches.where(F.coalesce("enabled", F.lit(True)))
    return live.withColumn("d", default).select(
        "watch", F.coalesce("title", "watch").alias("title"), *[F.coalesce(s, f"d.{s}").alias(s) for s in settings])


def resolve_source_sections(shared: DataFrame, own: DataFrame, transport: list[str], searches: list[str]) -> DataFrame:
    """Source section of each watch: shared transport overlaid by the watch's own values. Absent or disabled on
    either side means no section. Both inputs are configuration tables keyed by source."""
    on = shared.where(F.coalesce("enabled", F.lit(True))).select("source", *[F.col(t).alias(f"s_{t}") for t in transport])
    mine = own.where(F.coalesce("enabled", F.lit(True)))
    return mine.join(on, "source").select(
        "watch", "source", *[F.coalesce(t, f"s_{t}").alias(t) for t in transport], *searches)


def require_watch(watches: DataFrame) -> DataFrame:
    """The frame itself; running it fails when no watch is enabled."""
    n = watches.agg(F.count("*")).scalar()
    checked = F.when(n == 0, F.raise_error(F.lit("no enabled watch in the configuration")).cast("boolean")).otherwise(True)
    return watches.where(checked)

"""Source health from the fetch log, cooldowns, completeness of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_health(fetches: DataFrame, cooldown_hours: int = 12) -> DataFrame:
    """Per source: failures since the last success, end of the pause, last success, last error (500 characters).

    ``fetches`` (source, ts, fetch_id, ok, error) is read twice as partial aggregates; the only joined side holds
    one row per source.
    """
    at = F.struct("ts", "fetch_id")
    last = fetches.groupBy("source").agg(
        F.max(F.when(F.col("ok"), at)).alias("ok_at"),
        F.max_by(F.when(~F.col("ok"), F.substring("error", 1, 500)), F.when(~F.col("ok"), at)).alias("last_error"))
    after = fetches.where(~F.col("ok")).join(F.broadcast(last), "source").where(
        F.col("ok_at").isNull() | (at > F.col("ok_at")))
    failing = after.groupBy("source").agg(F.count("*").alias("failures"), F.max("ts").alias("blocked_at"))
    pause = F.make_dt_interval(hours=F.lit(cooldown_hours))
    return last.join(failing, "source", "left").select(
        "source", F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures"),
        (F.col("blocked_at") + pause).alias("blocked_until"), F.col("ok_at.ts").alias("last_ok"), "last_error")


def source_cooldown(fetches: DataFrame, slot_hours: int = 6, cooldown_hours: int = 12) -> DataFrame:
    """For every source and scan slot: is the source still paused when the slot starts?

    Only the last fetch before a slot matters. Fetches are first reduced to one row per (source, slot); the window
    then runs over slots, whose number is bounded by the length of the log.
    """
    width = slot_hours * 3600
    slot = F.call_function("div", F.unix_timestamp("ts"), F.lit(width))
    last = fetches.groupBy("source", slot.alias("slot")).agg(
        F.max_by(F.struct("ts", "ok"), F.struct("ts", "fetch_id")).alias("last"))
    w = Window.partitionBy("source").orderBy("slot")
    before = last.withColumn("before", F.lag("last").over(w))
    start = F.timestamp_seconds(F.col("slot") * width)
    until = F.col("before.ts") + F.make_dt_interval(hours=F.lit(cooldown_hours))
    paused = F.coalesce(~F.col("before.ok") & (until > start), F.lit(False))
    return before.select("source", start.alias("slot_start"), paused.alias("paused"),
                         F.when(paused, until).alias("blocked_until"))


def degraded_messages(fetches: DataFrame, labels: dict[str, str], timezone: str = "Europe/Paris",
                      cooldown_hours: int = 12) -> DataFrame:
    """One notice per source and local day: the first block of that day."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts"), timezone))
    first = fetches.where(~F.col("ok")).groupBy("source", day.alias("local_day")).agg(
        F.min_by("error", F.struct("ts", "fetch_id")).alias("error"))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("source")),
                      F.col("source"))
    pause = F.lit(f"Source mise en pause {cooldown_hours} h.")
    ads = F.concat(name, F.lit(" a répondu par un blocage ("), F.col("error"), F.lit("). "), pause, F.lit(
        "\nMode dégradé : activer « Sauvegarder la recherche » sur leboncoin pour recevoir leurs alertes mail."))
    other = F.concat(name, F.lit(" indisponible ("), F.col("error"), F.lit("). "), pause)
    return first.select("source", "local_day", F.concat(F.lit("Veille annonces : "), name, F.lit(" bloqué")).alias("title"),
                        F.when(F.col("source") == "lbc", ads).otherwise(other).alias("message"))


def _counted() -> Column:
    return F.coalesce(F.col("page_no") <= F.col("max_pages"), F.lit(True))


def _failed() -> Column:
    return (F.col("http_status") >= 400) | ~F.col("parsed")


def is_whole() -> Column:
    """Whether a page breaks no scan; null for pages after the reported last one, which do not count."""
    empty = (F.col("items") == 0) & (
        ((F.col("source") == "vinted") & (F.col("page_no") == 1)) | (F.col("source") == "hfr"))
    return F.when(_counted(), ~(_failed() | empty))


def scan_completeness(pages: DataFrame, overflow: DataFrame | None = None) -> DataFrame:
    """Whether each (scan, watch, source) was read whole.

    ``pages`` (scan_id, watch, source, page_no, max_pages, http_status, parsed, items). Pages after the reported last
    page do not count. A failed or throttled page, an empty first page of the card source, or any empty forum page
    breaks the scan; so does a candidate overflow (``overflow``: scan_id, watch, source, complete).
    """
    group = ["scan_id", "watch", "source"]
    whole = pages.where(_counted()).groupBy(*group).agg(
        F.bool_and(is_whole()).alias("complete"), F.count("*").alias("pages"), F.count_if(_failed()).alias("errors"))
    if overflow is None:
        return whole
    cut = overflow.where(~F.col("complete")).select(*group).distinct().withColumn("cut", F.lit(True))
    return whole.join(cut, group, "left").withColumn("complete", F.col("complete") & F.col("cut").isNull()).drop("cut")

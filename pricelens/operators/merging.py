"""Merging duplicate observations of one listing inside a scan, and whole-frame unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.functions.listing import status_of_rank, status_rank

KEY = ["watch", "source", "listing_id"]
SCAN_KEY = ["watch", "source", "scan_id", "listing_id"]
#: The keys of a listing from the one of most values on: sorts by listing compare the first bytes of the first key, and few listings share these.
BY_LISTING = ["listing_id", "source", "watch"]


def _pick(df: DataFrame, keys: list[str], *order: str, extra: dict | None = None) -> DataFrame:
    """One row per key, the smallest by ``order``: a partial aggregate, safe for a key holding most rows."""
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*rest), F.struct(*order)).alias("row")]
    aggs += [expr.alias(f"x_{name}") for name, expr in (extra or {}).items()]
    picked = df.groupBy(*keys).agg(*aggs)
    values = [F.coalesce(f"x_{c}", f"row.{c}").alias(c) if c in (extra or {}) else F.col(f"row.{c}").alias(c)
              for c in rest]
    return picked.select(*keys, *values)


def merge_pages_first(df: DataFrame, keys: list[str] = SCAN_KEY) -> DataFrame:
    """The first page a listing is seen on wins."""
    return _pick(df, keys, "seen_at", "obs_id")


def merge_pages_cheapest(df: DataFrame, keys: list[str] = SCAN_KEY) -> DataFrame:
    """The lowest delivered price wins, the first seen on ties."""
    return _pick(df, keys, "delivered_cents", "seen_at", "obs_id")


def merge_pages_worst_status(df: DataFrame, keys: list[str] = SCAN_KEY) -> DataFrame:
    """First page wins, except for the status (worst of all pages) and the description (first not empty)."""
    extra = {"status": status_of_rank(F.max(status_rank(F.col("status"))))}
    if "description" in df.columns:
        extra["description"] = F.min_by(
            F.when(F.col("description") != "", F.col("description")),
            F.when(F.col("description") != "", F.struct("seen_at", "obs_id")))
    return _pick(df, keys, "seen_at", "obs_id", extra=extra)


def merge_scan(df: DataFrame) -> DataFrame:
    """One row per listing and scan under each source's own rule, in a single aggregation.

    ``delivered_cents`` decides for the search API, page order for the others; only the classified-ads source
    keeps the worst status over its pages. After this step a listing has at most one row per scan, which
    bounds every later per-listing window by the number of scans.
    """
    lead = F.when(F.col("source") == "ebay", F.col("delivered_cents")).otherwise(F.lit(0))
    rest = [c for c in df.columns if c not in SCAN_KEY]
    merged = df.groupBy(*SCAN_KEY).agg(
        F.min_by(F.struct(*rest), F.struct(lead, "seen_at", "obs_id")).alias("row"),
        F.max(status_rank(F.col("status"))).alias("rank"))
    status = F.when(F.col("source") == "lbc", status_of_rank(F.col("rank"))).otherwise(F.col("row.status"))
    return merged.select(*SCAN_KEY, *[status.alias(c) if c == "status" else F.col(f"row.{c}") for c in rest])


#: What merging and the timeline need of a sighting besides its keys.
SIGHTING = ("seen_at", "obs_id", "status", "delivered_cents", "unit_cents")


def merge_judged(judged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per listing and scan of judged sightings, with the named columns alone.

    Rows are judged one by one and without their status, so judging them first gives the same rows; and only what is asked for is shuffled and sorted:
    Spark prunes no columns through the merge's struct by itself."""
    return merge_scan(judged.select(*dict.fromkeys([*SCAN_KEY, *SIGHTING, *columns])))


def union_frames(*frames: DataFrame) -> DataFrame:
    """Union by name; columns a frame does not know become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def page_dedup(pages: DataFrame) -> DataFrame:
    """One read per URL and scan: the first one."""
    rest = [c for c in pages.columns if c not in ("scan_id", "url")]
    return pages.groupBy("scan_id", "url").agg(F.min_by(F.struct(*rest), F.struct("fetched_at", "page_id")).alias("r")) \
        .select("scan_id", "url", "r.*")


def topics_to_read(topics: DataFrame, cache: DataFrame) -> DataFrame:
    """Topics whose last post moved since they were cached; a topic without a date is always read."""
    dated = cache.where(F.col("last_post") != "").select("url", "last_post").distinct()
    return topics.join(dated, ["url", "last_post"], "left_anti")


def schema_backfill(old: DataFrame, template: DataFrame, watch: str) -> DataFrame:
    """Old rows in the current schema: missing columns are added, rows without a watch get ``watch``. Idempotent."""
    full = template.limit(0).unionByName(old, allowMissingColumns=True)
    fill = {"watch": watch, "review": "", "note": ""}
    return full.select(*[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in template.columns])


def scan_topn_budget(candidates: DataFrame, budgets: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """First ``budget`` candidates of each (watch, source, scan), and whether that was all of them.

    ``position <= largest budget`` is a constant bound, so Spark limits each group per task before the
    shuffle; the exact budget of the source is applied after it. The totals are partial counts.
    """
    group = ["watch", "source", "scan_id"]
    ranked = candidates.withColumn(
        "position", F.row_number().over(Window.partitionBy(*group).orderBy("seen_at", "listing_id", "obs_id")))
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("source"))
    chosen = ranked.where(F.col("position") <= max(budgets.values())).where(F.col("position") <= budget)
    totals = candidates.groupBy(*group).agg(F.count("*").alias("candidates"))
    return chosen, totals.withColumn("complete", F.col("candidates") <= budget)

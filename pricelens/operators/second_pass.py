"""Second pass of a scan: details for new, kept listings within a budget, and a new judgement of those alone."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.sources.details import DETAIL_COLS, KEY, enrich_details

SCAN = ["watch", "source", "scan_id"]


def mark_new(rows: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``is_new`` on each listing's first scan in ``rows``, unless ``previous`` (a state) knows the listing already."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("scan_id")) == 1
    if previous is None:
        return rows.withColumn("is_new", first)
    known = previous.select(*KEY).withColumn("known", F.lit(True))
    return rows.join(known, KEY, "left").withColumn("is_new", first & F.col("known").isNull()).drop("known")


def within_budget(rows: DataFrame, details: DataFrame, budgets: Mapping[str, int]) -> DataFrame:
    """Details that a scan of ``rows`` (is_new, keep) reads: of each watch, source and scan the first ones that exist, in the order in which
    the listings came, as many as the source's budget allows. A listing without a detail costs nothing; sources without a budget read none.

    (KEY, scan_id, and the columns of ``details``); one detail per listing is taken for granted."""
    wanted = rows.where(F.col("is_new") & F.col("keep") & F.col("source").isin(*budgets)).select(*KEY, "scan_id", "seen_at", "obs_id")
    found = wanted.join(details.select(*KEY, *[c for c in DETAIL_COLS if c in details.columns]), KEY)
    place = F.row_number().over(Window.partitionBy(*SCAN).orderBy("seen_at", "obs_id", "listing_id"))
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("source"))
    # the constant bound lets every task drop the rest of a scan before the shuffle
    chosen = found.withColumn("place", place).where(F.col("place") <= max(budgets.values(), default=0)).where(F.col("place") <= budget)
    return chosen.drop("place", "seen_at", "obs_id")


def second_pass(rows: DataFrame, details: DataFrame, budgets: Mapping[str, int], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with ``enriched``: those within the budget are completed by their details (see ``enrich_details``) and judged again, the others
    stay as they were judged. ``judge`` classifies and scores listing rows; it sees enriched rows alone, with the columns that ``rows`` had.
    """
    at = [*KEY, "scan_id"]
    read = within_budget(rows, details, budgets)
    flagged = rows.join(read.select(*at, F.lit(True).alias("chosen")), at, "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    done = enrich_details(flagged.where("chosen").withColumn("keep", F.lit(True)), read.drop("scan_id")).where("enriched")
    again = judge(done.drop("chosen", "enriched"))
    known = [c for c in again.columns if c in rows.columns]
    rest = flagged.where(~F.col("chosen")).drop("chosen").withColumn("enriched", F.lit(False))
    return rest.unionByName(again.select(*known).withColumn("enriched", F.lit(True)), allowMissingColumns=True)

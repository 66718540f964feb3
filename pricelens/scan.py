"""A whole scan as one plan: raw pages of all sources in; scan log, judged sightings, state, price points and alerts out.

    pages -> read_pages -> as_listings -> merge_scan -> classify, score -> second pass -> timeline -> snapshot

The scan log, listings, their first and their second judgement are stored in the checkpoint folder when the frames are made; what the sinks need
of them is lazy. ``store`` writes all sinks and keeps the sightings, which they share, in between.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.money import delivered_cents
from pricelens.operators import history as hi
from pricelens.operators.merging import merge_scan
from pricelens.operators.profiles import classify_by_watch, with_market_names
from pricelens.operators.scans import SCAN, scan_facts, scan_log_of
from pricelens.operators.scoring import score
from pricelens.operators.second_pass import mark_new, second_pass
from pricelens.session import checkpoint_folder, shared_folder
from pricelens.sources import sinks
from pricelens.sources.embedded_json import island_facts
from pricelens.sources.registry import read_pages

#: What every source's listings look like once they are read; what a source does not tell is null.
CONTRACT = {
    "watch": "string", "source": "string", "scan_id": "date", "obs_id": "bigint", "seen_at": "timestamp", "listing_id": "string", "url": "string", "title": "string",
    "description": "string", "price_cents": "bigint", "shipping_cents": "bigint", "shipping_estimated": "boolean", "fees_cents": "bigint", "condition": "string",
    "condition_code": "string", "seller_name": "string", "seller_type": "string", "seller_rating": "double", "seller_reviews": "bigint", "location": "string",
    "country": "string", "delivery": "boolean", "secure_payment": "boolean", "stock": "bigint", "returns": "string", "status": "string", "posted_at": "string"}


def as_listings(rows: DataFrame) -> DataFrame:
    """Rows of ``read_pages`` in the contract's columns and types. The page (``page_id``, ``fetched_at``) dates the sighting."""
    named = rows.withColumnsRenamed({"page_id": "obs_id", "fetched_at": "seen_at"})
    out = named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(t).alias(c) for c, t in CONTRACT.items()])
    return out.fillna({"shipping_estimated": False}).withColumn("delivered_cents", delivered_cents(F.col("price_cents"), F.col("shipping_cents"), F.col("fees_cents")))


def page_facts(pages: DataFrame) -> DataFrame:
    """(watch, source, scan_id, page_no, max_pages, http_status, parsed, items): what each captured page says about its scan.

    A page of classified ads without a readable island and an empty body of any source are not parsed."""
    ads = F.col("source") == "lbc"
    islands = island_facts(pages.where(ads).select(*SCAN, "body"))
    cell = lambda v, kind: F.lit(v).cast(kind)
    columns = lambda df, pages_of, parsed, items: df.select(*SCAN, cell(1, "bigint").alias("page_no"), pages_of.cast("bigint").alias("max_pages"),
                                                            cell(200, "bigint").alias("http_status"), parsed.alias("parsed"), items.cast("bigint").alias("items"))
    others = pages.where(~ads)
    return columns(islands, F.col("max_pages"), F.col("parsed"), F.col("ads")).unionAll(
        columns(others, cell(None, "bigint"), F.coalesce(F.trim("body") != "", F.lit(False)), cell(None, "bigint")))


@dataclass(frozen=True)
class Scan:
    """Frames of a scan: the scan log so far, sightings with their events, and the state with its alerts."""

    scans: DataFrame
    lines: DataFrame
    gone_after: int = hi.GONE_AFTER

    @property
    def state(self) -> DataFrame:
        return hi.snapshot(self.lines, self.scans, True, self.gone_after)

    @property
    def alerts(self) -> DataFrame:
        return self.state.select(*hi.KEY, F.inline("alerts"))

    def store(self, root: str) -> None:
        """State, price points and alerts under ``root``; the sightings are computed once for all three."""
        kept = Scan(self.scans.persist(), self.lines.persist(), self.gone_after)
        try:
            sinks.sink_state(kept.state, f"{root}/state")
            sinks.sink_history(hi.price_history(kept.lines), f"{root}/history")
            sinks.sink_alerts(kept.lines.sparkSession.read.parquet(f"{root}/state").select(*hi.KEY, F.inline("alerts")), f"{root}/alerts")
        finally:
            kept.lines.unpersist()
            kept.scans.unpersist()


def _stored(rows: DataFrame) -> DataFrame:
    """The same rows from the shared checkpoint folder: each judgement is made once."""
    checkpoint_folder(rows.sparkSession)
    return rows.checkpoint()


def _by_watch(rows: DataFrame) -> DataFrame:
    """The same rows from a table of one folder for each watch: each profile reads the folders of its watches, so that all of them
    together read every row once. A watch of many rows is written by several tasks."""
    path = shared_folder(rows.sparkSession, "by-watch")
    rows.hint("rebalance", "watch").write.partitionBy("watch").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scan(pages: DataFrame, watches: Mapping[str, Mapping[str, Any]], rules: DataFrame, details: DataFrame | None = None, budgets: Mapping[str, int] | None = None,
         market: DataFrame | None = None, previous: DataFrame | None = None, earlier_facts: DataFrame | None = None,
         read: Callable[[DataFrame], DataFrame] = read_pages, gone_after: int = hi.GONE_AFTER) -> Scan:
    """One scan of captured pages (watch, source, scan_id, page_id, fetched_at, url, body), of any number of watches and sources.

    ``watches`` are resolved settings and ``rules`` their frame; ``details`` and ``budgets`` make the second pass; ``previous`` and ``earlier_facts``
    continue from a stored state and its scan log. Pages of classified ads, API, cards and forum go through one plan: each source's
    reader sees its own pages, everything behind ``as_listings`` is shared.
    """
    def judge(rows: DataFrame) -> DataFrame:
        listing = [c for c in rows.columns if c in CONTRACT or c in ("delivered_cents", "is_new")]
        return score(with_market_names(classify_by_watch(rows.select(*listing), watches), watches), rules, market)

    rows = _stored(judge(_by_watch(merge_scan(as_listings(read(pages))))))
    if details is not None:
        rows = _stored(second_pass(mark_new(rows, previous), details, budgets or {}, judge))
    facts = scan_facts(page_facts(pages))
    scans = _stored(scan_log_of(facts if earlier_facts is None else earlier_facts.unionByName(facts)))  # pages are read once for it
    return Scan(scans, hi.timeline(rows, scans, previous, gone_after), gone_after)

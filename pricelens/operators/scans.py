"""The scan log as data of its own: what was fetched, whether it was whole, and in which order.

A scan that was read whole and returned nothing is a row here and nowhere else; it is what makes vanished listings gone.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricelens.operators.health import is_whole

SCAN = ["watch", "source", "scan_id"]
PAGE_DDL = ("watch string, source string, scan_id date, page_no bigint, max_pages bigint, http_status bigint, parsed boolean, items bigint")


def scan_facts(pages: DataFrame, sightings: DataFrame | None = None) -> DataFrame:
    """(watch, source, scan_id, complete, ended): what these pages and sightings say about their scans.

    ``ended`` tells that the last page the source announced was among them. Sightings of a scan without a page prove that
    there was a scan, not that it was whole (complete is null). Facts of one scan may come in several parts; see ``scan_log_of``.
    """
    ended = F.bool_or(F.coalesce(F.col("page_no") >= F.col("max_pages"), F.lit(True))).alias("ended")
    known = reduce(and_, [F.col(c).isNotNull() for c in SCAN])  # nothing tells that pages of an unknown scan are all there are
    facts = pages.groupBy(*SCAN).agg(F.bool_and(is_whole()).alias("complete"), ended)
    facts = facts.select(*SCAN, F.coalesce(F.when(known, F.col("complete")), F.lit(True)).alias("complete"), "ended")  # only pages behind the last one
    if sightings is None:
        return facts
    seen = sightings.select(*SCAN).distinct().select(*SCAN, F.lit(None).cast("boolean").alias("complete"), F.lit(False).alias("ended"))
    return facts.unionByName(seen)


def scan_log_of(facts: DataFrame) -> DataFrame:
    """One row per scan with its place among the scans of its watch and source, from facts in any number of parts and any order.

    A scan is complete if all its parts are and at least one holds pages; ``closed`` if its last page was read or a later scan has begun. As
    many rows as there were scans, whatever the number of listings.
    """
    scans = facts.groupBy(*SCAN).agg(F.coalesce(F.bool_and("complete"), F.lit(False)).alias("complete"), F.bool_or("ended").alias("ended"))
    w = Window.partitionBy("watch", "source").orderBy("scan_id")
    return scans.select(*SCAN, "complete", (F.col("ended") | F.lead("scan_id").over(w).isNotNull()).alias("closed"),
                        F.row_number().over(w).alias("scan_no"), F.sum(F.col("complete").cast("int")).over(w).alias("complete_through"))


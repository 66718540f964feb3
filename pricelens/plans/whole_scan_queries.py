"""Whole scans: pages of all four sources, rendered from the line items, through one plan to state and counters."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pricelens.config import resolve_watches, watch_frame
from pricelens.operators import reports as rp
from pricelens.operators.merging import union_frames
from pricelens.operators.profiles import PROFILES
from pricelens.plans import frames as fr
from pricelens.plans.ingest_queries import _ads_sql, ad_pages, api_pages, captured, card_pages, list_pages, post_pages, QUERIES
from pricelens.plans.listing_queries import STATE_OUT, state_columns
from pricelens.plans.oracle import CTES, compose
from pricelens.plans.registry import query
from pricelens.plans.report_queries import scan_counters  # noqa: F401  (its SQL is the base of ours)
from pricelens.plans.registry import ORACLE
from pricelens.plans.settings import RAW
from pricelens.scan import Scan, scan
from pricelens.sources.registry import SOURCES, forum_source, read_pages

KEY = ["watch", "source", "listing_id"]
KEYWORDS = {"families": [{"name": n.title(), "any": [n]} for n in ("widget", "bolt", "ring")], "reject": ["gizmo"]}
WATCHES = resolve_watches(RAW | {"watches": {n: w | {"profile": {"type": "keywords", "keywords": KEYWORDS | {
    k: v for k, v in (w["profile"].get("keywords") or {}).items()}}} for n, w in RAW["watches"].items()}})
BUDGETS = {"lbc": 2, "ebay": 3, "vinted": 1, "hfr": 2}

# ---------------------------------------------------------------- SQL

_OTHER = "FALSE AS f_multi, FALSE AS f_refmiss, FALSE AS f_low, FALSE AS f_unver"
_FAMILY = "CASE WHEN title LIKE '%widget%' THEN 'Widget' WHEN title LIKE '%bolt%' THEN 'Bolt' WHEN title LIKE '%ring%' THEN 'Ring' END"


def _listing(listing_id: str, price: str, shipping: str, fees: str, delivery: str, secure: str, reviews: str, status: str, parts: str, age: str, source: str) -> str:
    return (f"SELECT watch, source, {listing_id} AS listing_id, scan_id, obs_id, seen_at, CAST({price} AS BIGINT) AS price_cents, CAST({shipping} AS BIGINT) AS shipping_cents, "
            f"CAST({fees} AS BIGINT) AS fees_cents, {delivery} AS delivery, {secure} AS secure_payment, CAST({reviews} AS BIGINT) AS seller_reviews, {status} AS status, CAST({age} AS BIGINT) AS age_days, "
            f"CASE WHEN {parts} OR title LIKE '%gizmo%' THEN 'reject' ELSE 'accept' END AS verdict, CAST(NULL AS VARCHAR) AS model, {_FAMILY} AS family, title FROM {source}")


def _lbc(listing_id: str, status: str) -> str:
    shown = re.search(r"CAST\((CASE WHEN shipping_cents IS NULL .*? END) AS BIGINT\) AS shipping_cents", _ads_sql("x", "y")).group(1)
    return _listing(listing_id, "price_cents", shown, "CASE WHEN shipping_cents IS NULL THEN 0 ELSE fees_cents END", "shipping_cents IS NOT NULL", "obs_id % 10 % 3 <> 0", "seller_reviews",
                    status, "condition = 'Pour pièces'", "age_days", "log0 WHERE source = 'lbc' AND obs_id % 71 > 1")


SWAP = {
    "log": "WITH log0 AS (" + CTES["log"] + "), hfr0 AS (SELECT l.*, o.p_name FROM log0 l JOIN (SELECT DISTINCT p_name, p_name || ' ' || p_brand AS title FROM obs) o ON o.title = l.title "
           "WHERE l.source = 'hfr' AND l.obs_id % 10 % 4 > 1 AND ((p_name LIKE '%red%' AND p_name LIKE '%widget%') OR p_name LIKE '%blue%' OR p_name LIKE '%bolt%')) "
           "SELECT *, price_cents + coalesce(shipping_cents, 0) + fees_cents AS delivered_cents, CAST(1 AS BIGINT) AS quantity, family IS NULL AS f_unknown, " + _OTHER + " FROM ("
           + " UNION ALL ".join([
               _lbc("listing_id", "CASE WHEN status = 'sold' THEN 'sold' WHEN status = 'pending' THEN 'pending' WHEN obs_id % 10 = 1 THEN 'gone' ELSE 'active' END"),
               _lbc("CAST(CAST(listing_id AS BIGINT) + 1000000 AS VARCHAR)", "'sold'"),
               _listing("'v1|' || listing_id", "price_cents", "shipping_cents", "0", "TRUE", "TRUE", "seller_reviews", "'active'", "condition_id = '7000'", "age_days", "log0 WHERE source = 'ebay'"),
               _listing("listing_id", "price_cents", "890", "CASE WHEN obs_id % 10 % 3 = 0 THEN 0 ELSE fees_cents END", "TRUE", "TRUE", "NULL", "'active'", "FALSE", "NULL", "log0 WHERE source = 'vinted'"),
               _listing("CAST(obs_id AS VARCHAR)", "price_cents // 100 * 100", "CASE WHEN obs_id % 10 % 3 = 2 THEN 0 END", "0", "obs_id % 10 % 3 <> 1", "CAST(NULL AS BOOLEAN)",
                        "coalesce(seller_reviews, 0)", "CASE WHEN status = 'sold' THEN 'sold' ELSE 'active' END", "FALSE", "0", "hfr0")]) + ")",
}
# the first judgement, then the details of those that it keeps
_FIRST = ", ".join(f"{n}0 AS ({re.sub(r'\b(merged|priced|staged)\b', r'\g<1>0', CTES[n])})" for n in ("priced", "staged", "decided"))
SWAP["merged"] = (f"WITH merged0 AS ({CTES['merged']}), {_FIRST}, "
                  "d AS (SELECT d.*, p_size, row_number() OVER (PARTITION BY watch, source, scan_id ORDER BY seen_at, obs_id, listing_id) AS place FROM "
                  "(SELECT *, row_number() OVER (PARTITION BY watch, source, listing_id ORDER BY scan_id) AS nth FROM decided0) d "
                  "JOIN part ON p_partkey % 4 <> 0 AND p_type = watch AND listing_id = CASE source WHEN 'ebay' THEN 'v1|' ELSE '' END || p_partkey WHERE source <> 'hfr' AND nth = 1 AND keep), "
                  "e AS (SELECT watch, source, scan_id, listing_id, p_size FROM d WHERE place <= CASE source WHEN 'lbc' THEN 2 WHEN 'ebay' THEN 3 WHEN 'vinted' THEN 1 ELSE 2 END) "
                  "SELECT m.* REPLACE (CASE WHEN p_size % 6 = 0 THEN 'reject' ELSE verdict END AS verdict, CASE WHEN p_size % 10 = 5 THEN 'sold' ELSE status END AS status, "
                  "coalesce(shipping_cents, CASE WHEN p_size % 3 = 0 THEN 1290 END) AS shipping_cents, "
                  "delivered_cents + CASE WHEN shipping_cents IS NULL AND p_size % 3 = 0 THEN 1290 ELSE 0 END AS delivered_cents), p_size IS NOT NULL AS enriched "
                  "FROM merged0 m LEFT JOIN e USING (watch, source, scan_id, listing_id)")
SWAP["scans"] = CTES["scans"][:CTES["scans"].index("FROM (SELECT DISTINCT")] + (
    "FROM (SELECT watch, source, scan_id, NOT bool_or(source = 'lbc' AND obs_id % 71 <= 1) AS complete FROM obs GROUP BY ALL)")
_COUNTERS = re.sub(r"least\(count\(f\.rn2\) FILTER \(f\.event = 'new' AND s\.keep\), CASE .*? END\) AS enriched", "count(f.rn2) FILTER (s.enriched) AS enriched", ORACLE["scan_counters"])
_COUNTERS = _COUNTERS[_COUNTERS.rindex("\nSELECT x.watch") + 1:]

# ---------------------------------------------------------------- Spark


def raw_pages(spark, sf):
    """Pages of all sources in one captured table."""
    topics = post_pages(spark, sf).drop("topic").withColumn("url", F.concat(F.lit("https://forum.example/hfr/x-sujet_"), "page_id", F.lit("_1.htm")))
    every = union_frames(*[p.withColumn("source", F.lit(n)) for n, p in (
        ("lbc", ad_pages(spark, sf)), ("ebay", api_pages(spark, sf)), ("vinted", card_pages(spark, sf)), ("hfr", list_pages(spark, sf)), ("hfr", topics))])
    return captured(every)


def detail_rows(spark, sf):
    part, size = fr.table(spark, sf, "part").where(F.col("p_partkey") % 4 != 0), F.col("p_size")
    own = F.col("p_partkey").cast("string")
    keys = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), i.alias("listing_id")) for s, i in (("lbc", own), ("ebay", F.concat(F.lit("v1|"), own)), ("vinted", own))])).alias("k")
    rows = part.select(F.col("p_type").alias("watch"), "p_size", keys)
    return rows.select("watch", "k.*", F.when(size % 6 == 0, "gizmo inside").otherwise("fine").alias("description"),
                       F.when(size % 3 == 0, F.lit(1290).cast("bigint")).alias("shipping_cents"), F.when(size % 10 == 5, "sold").otherwise("active").alias("status"))


def forum_narrowed(pages):
    """``read_pages`` with the forum's searches."""
    known = dict(SOURCES)
    try:
        SOURCES["hfr"] = forum_source(QUERIES)
        return read_pages(pages)
    finally:
        SOURCES.clear()
        SOURCES.update(known)


def whole_scan(spark, sf) -> Scan:
    rules = watch_frame(spark, WATCHES, PROFILES)
    return scan(raw_pages(spark, sf), WATCHES, rules, detail_rows(spark, sf), BUDGETS, read=forum_narrowed)


@query("whole_scan_state", compose(f"SELECT {STATE_OUT} FROM state", "cfg", "state", swap=SWAP))
def whole_scan_state(spark, sf):
    """State of all sources' pages after second passes; pages are rendered and captured when the frame is made."""
    return state_columns(whole_scan(spark, sf).state)


@query("whole_scan_counters", compose(_COUNTERS, "cfg", "fold", "scans", swap=SWAP))
def whole_scan_counters(spark, sf):
    """Counters of the same scans: details that were really read, alerts and vanished listings."""
    found = whole_scan(spark, sf)
    out = rp.scan_counters(found.lines, found.alerts, found.scans, BUDGETS)
    return out.withColumn("scan", fr.text(F.col("scan_id"))).drop("scan_id")

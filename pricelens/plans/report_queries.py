"""Queries over the merged state: alerts, digest, statistics, searches, source health, configuration."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pricelens.operators import alerts as al
from pricelens.operators import config_frames as cf
from pricelens.operators import health as he
from pricelens.operators import history as hi
from pricelens.operators import merging as mg
from pricelens.operators import reports as rp
from pricelens.operators import reviews as rv
from pricelens.operators import scoring as sc
from pricelens.config import watch_frame
from pricelens.operators.profiles import PROFILES
from pricelens.plans import frames as fr
from pricelens.plans.oracle import CAN_ALERT, CTES, DEPS, RECURSIVE, compose, eur
from pricelens.plans.registry import query
from pricelens.plans.settings import BUDGETS, COOLDOWN_HOURS, SOURCE_LABELS, WATCHES
from pricelens.session import stored

KEY = ["watch", "source", "listing_id"]
SOURCE_SQL = "CASE {0} % 4 WHEN 0 THEN 'lbc' WHEN 1 THEN 'ebay' WHEN 2 THEN 'vinted' ELSE 'hfr' END"

CTES["reviews"] = f"""
  SELECT p.p_type AS watch, {SOURCE_SQL.format('o_orderkey')} AS source, CAST(o_custkey AS VARCHAR) AS listing_id, o_orderdate AS ts,
    o_orderkey AS event_id, CASE o_orderstatus WHEN 'F' THEN 'seen' WHEN 'O' THEN 'starred' ELSE 'ignored' END AS review,
    CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS note
  FROM orders JOIN part p ON o_custkey = p.p_partkey"""
CTES["overlay"] = """
  SELECT watch, source, listing_id, last(review ORDER BY ts, event_id) AS review,
    coalesce(last(note ORDER BY ts, event_id) FILTER (WHERE note IS NOT NULL), '') AS note
  FROM reviews GROUP BY watch, source, listing_id"""
CTES["rstate"] = """
  SELECT s.*, coalesce(o.review, '') AS review, coalesce(o.note, '') AS note FROM state s LEFT JOIN overlay o
    ON o.watch = s.watch AND o.source = s.source AND o.listing_id = s.listing_id"""
CTES["seqr"] = """
  SELECT s.*, coalesce((SELECT last(r.review ORDER BY r.ts, r.event_id) FROM reviews r WHERE r.watch = s.watch AND r.source = s.source
    AND r.listing_id = s.listing_id AND r.ts < s.scan_id), '') AS review FROM seq s"""
_no_review = CAN_ALERT.format(m="status", review=""), CAN_ALERT.format(m="merged", review="")
_fold = CTES["fold"].replace(_no_review[0], CAN_ALERT.format(m="status", review=" AND review <> 'ignored'")).replace(
    _no_review[1], CAN_ALERT.format(m="merged", review=" AND review <> 'ignored'"))
CTES["foldr"] = re.sub(r"\bseq\b", "seqr", re.sub(r"\bfold\b", "foldr", _fold))
RECURSIVE.add("foldr")
DEPS.update({"reviews": [], "overlay": ["reviews"], "rstate": ["state", "overlay"], "seqr": ["seq", "reviews"], "foldr": ["seqr"]})


def review_events(spark, sf):
    orders, part = fr.table(spark, sf, "orders"), fr.table(spark, sf, "part").select("p_partkey", "p_type")
    note = F.when(F.col("o_orderpriority") == "5-LOW", None).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(
        F.col("o_orderpriority"))
    return orders.join(part, orders.o_custkey == part.p_partkey).select(
        F.col("p_type").alias("watch"), fr.source_name(F.col("o_orderkey")).alias("source"),
        F.col("o_custkey").cast("string").alias("listing_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("event_id"),
        F.when(F.col("o_orderstatus") == "F", "seen").when(F.col("o_orderstatus") == "O", "starred").otherwise("ignored")
        .alias("review"), note.alias("note"))


def reviewed_state(spark, sf, *columns):
    return rv.with_reviews(fr.stored_state(spark, sf, columns), rv.review_overlay(review_events(spark, sf)))


def reviewed_lines(spark, sf):
    """What deciding on alerts needs of each sighting, with the review in force."""
    effective = F.add_months(F.trunc(F.to_date("ts"), "month"), 1)
    # A review at the very first instant of a month precedes that month's scan only when it is strictly before it.
    return rv.review_at_scan(fr.lines(spark, sf, fr.ALERTING), review_events(spark, sf), effective)


@query("review_overlay", compose("SELECT * FROM overlay", "overlay"))
def review_overlay(spark, sf):
    return rv.review_overlay(review_events(spark, sf))


ALERT_SQL = ("SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, alert AS event, unit_cents, "
             "prev_notified AS prev_cents, suspicious <> '' AS suspicious FROM foldr WHERE alert IS NOT NULL")


@query("alert_stream", compose(ALERT_SQL, "foldr"))
def alert_stream(spark, sf):
    rows = al.alert_rows(al.fold_alerts(reviewed_lines(spark, sf)))
    return rows.select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "event", "unit_cents", "prev_cents", "suspicious")


def _label_sql(alias: str = "") -> str:
    return ("CASE WHEN family IS NOT NULL AND model IS NOT NULL THEN family || ' ' || model WHEN family IS NOT NULL THEN family || ' (réf. ?)' "
            "WHEN model IS NOT NULL THEN model WHEN brand IS NOT NULL THEN brand || ' modèle inconnu' ELSE 'Modèle inconnu' END")


SRC_LABEL_SQL = "CASE source WHEN 'lbc' THEN 'LBC' WHEN 'ebay' THEN 'eBay' WHEN 'vinted' THEN 'Vinted' ELSE 'HFR' END"
PER_SQL = ("CASE WHEN divisor > 0 THEN ' (' || replace(regexp_replace(printf('%.2f', ((2 * unit_cents + divisor) // (2 * divisor)) / 100.0), "
           "'[.]00$', ''), '.', ',') || ' ' || unit_label || ')' ELSE '' END")


def _notes_sql() -> str:
    from pricelens.plans.listing_queries import NOTES_SQL

    return NOTES_SQL


ALERT_MESSAGE_SQL = f"""
  SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, event,
    CASE WHEN suspicious <> '' THEN '⚠️ ' ELSE '' END || CASE WHEN event = 'price_drop' THEN '↓ ' ELSE '' END ||
    CASE WHEN wlabel <> '' THEN '[' || wlabel || '] ' ELSE '' END || '[' || {SRC_LABEL_SQL} || '] ' || {_label_sql()} || ' — ' ||
    {eur('unit_cents')} || CASE WHEN quantity > 1 THEN ' ×' || quantity ELSE '' END || {PER_SQL} AS title,
    concat_ws(chr(10), 'Modèle : ' || {_label_sql()},
      'Prix rendu : ' || {eur('delivered_cents')} || ' (' || {eur('price_cents')} || ' + port ' ||
        CASE WHEN shipping_cents IS NULL THEN 'inconnu' ELSE {eur('shipping_cents')} || CASE WHEN shipping_estimated THEN ' est.' ELSE '' END END ||
        CASE WHEN fees_cents > 0 THEN ' + frais ' || {eur('fees_cents')} ELSE '' END || ')',
      CASE WHEN quantity > 1 THEN 'Lot de ' || quantity || ' → ' || {eur('unit_cents')} || ' par article' END,
      CASE WHEN event = 'price_drop' THEN 'Avant : ' || {eur('prev_notified')} || ' par article' END,
      CASE WHEN condition <> '' THEN 'État : ' || condition END,
      'Vendeur : ' || seller_name || CASE WHEN seller_rating IS NULL THEN '' ELSE ' (' || seller_rating || ' %, ' || seller_reviews || ' avis)' END
        || ' · ' || seller_type,
      'Lieu : ' || location, CASE WHEN delivery THEN 'Livraison : oui' WHEN NOT delivery THEN 'Livraison : non' END,
      CASE WHEN notes <> '' THEN '• ' || replace(notes, '|', chr(10) || '• ') END,
      CASE WHEN suspicious <> '' THEN '⚠ ' || replace(suspicious, '|', chr(10) || '⚠ ') END) AS message,
    CAST(CASE CASE WHEN suspicious <> '' THEN 'low' ELSE priority END WHEN 'urgent' THEN 5 WHEN 'default' THEN 3 WHEN 'low' THEN 2 END AS INTEGER) AS priority,
    concat_ws(',', source, nullif(tags, ''), CASE WHEN event = 'price_drop' THEN 'arrow_down' END, CASE WHEN suspicious <> '' THEN 'warning' END) AS tags,
    url AS click
  FROM (SELECT s.*, f.alert AS event, f.prev_notified, {_notes_sql()} AS notes FROM foldr f JOIN seqr s USING (watch, source, listing_id, rn2)
        WHERE f.alert IS NOT NULL)"""


def told_alerts(spark, sf):
    """All alerts, stored when the frame is made: their texts read them twice, to name the sightings and to tell what happened."""
    return stored(al.alert_rows(al.fold_alerts(reviewed_lines(spark, sf))), "alerts")


def alerted_facts(spark, sf, alerts):
    """All facts of the sightings that alert, as ``alert_messages`` takes them; the others are told apart before their texts are made and moved."""
    return fr.facts_of(spark, sf, alerts).withColumn("carried", F.lit(False))


@query("alert_message", compose(ALERT_MESSAGE_SQL, "foldr"))
def alert_message(spark, sf):
    """Alerts as they are pushed; they are decided when the frame is made."""
    alerts = told_alerts(spark, sf)
    rows = al.alert_messages(alerts, alerted_facts(spark, sf, alerts), SOURCE_LABELS)
    return rows.select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "event", "title", "message",
                       F.col("priority").cast("int").alias("priority"), F.array_join("tags", ",").alias("tags"), "click")


@query("format_price", compose(f"SELECT watch, source, listing_id, obs_id, {eur('price_cents')} AS price, {eur('shipping_cents')} AS shipping FROM log", "log"))
def format_price(spark, sf):
    from pricelens.functions.money import format_price as fp

    return fr.observation_log(spark, sf).select(*KEY, "obs_id", fp(F.col("price_cents")).alias("price"),
                                                fp(F.col("shipping_cents")).alias("shipping"))


DIGEST_SQL = f"""
  SELECT watch, n, 'Digest ' || wtitle || ' — ' || n || ' annonce' || s || ' active' || s AS title,
    body || CASE WHEN n > 25 THEN chr(10) || '… et ' || (n - 25) || ' autres' ELSE '' END AS message
  FROM (SELECT d.watch, any_value(c.wtitle) AS wtitle, any_value(n) AS n, CASE WHEN any_value(n) > 1 THEN 's' ELSE '' END AS s,
      string_agg(line, chr(10) ORDER BY rn) AS body
    FROM (SELECT watch, count(*) OVER (PARTITION BY watch) AS n, row_number() OVER (PARTITION BY watch ORDER BY unit_cents, source, listing_id) AS rn,
        {eur('unit_cents')} || CASE WHEN quantity > 1 THEN ' ×' || quantity ELSE '' END || ' · [' || {SRC_LABEL_SQL} || '] ' ||
        coalesce(nullif(concat_ws(' ', family, model), ''), 'Modèle inconnu') || ' · ' || location || chr(10) || url AS line
      FROM rstate WHERE keep AND status = 'active' AND suspicious = '' AND review <> 'ignored') d
    JOIN cfg c ON c.watch = d.watch AND c.enabled WHERE rn <= 25 GROUP BY d.watch)"""


@query("daily_digest", compose(DIGEST_SQL, "rstate", "cfg"))
def daily_digest(spark, sf):
    return rp.daily_digest(reviewed_state(spark, sf, "url", "model", "family", "quantity", "location"), fr.watches(spark), SOURCE_LABELS)


def _tally_sql(col: str) -> str:
    return (f"(SELECT string_agg({col} || ':' || n, '|' ORDER BY {col} || ':' || n) FROM (SELECT {col}, count(*) AS n FROM state t "
            f"WHERE w.watch = '' OR t.watch = w.watch GROUP BY {col}))")


@query("watch_stats", compose(
    f"SELECT w.watch, (SELECT count(*) FROM state t WHERE w.watch IN ('', t.watch)) AS listings, "
    f"(SELECT count(*) FROM state t WHERE w.watch IN ('', t.watch) AND keep AND status = 'active') AS kept_active, "
    f"(SELECT count(*) FROM state t WHERE w.watch IN ('', t.watch) AND notify_count > 0) AS notified, "
    f"(SELECT count(*) FROM history t WHERE w.watch IN ('', t.watch)) AS price_points, "
    f"{_tally_sql('status')} AS by_status, {_tally_sql('verdict')} AS by_verdict "
    f"FROM (SELECT DISTINCT watch FROM state UNION ALL SELECT '') w", "state", "history"))
def watch_stats(spark, sf):
    return rp.watch_stats(fr.state(spark, sf, columns=("verdict", *fr.ALERTING)))


OVERVIEW_AS_OF = "2001-06-02"


@query("watch_overview", compose(
    f"SELECT c.watch, c.wtitle AS title, (SELECT strftime(max(scan_id), '%Y-%m-%d') FROM scans x WHERE x.watch = c.watch) AS last_scan, "
    f"(SELECT count(*) FROM rstate s WHERE s.watch = c.watch AND keep AND status = 'active') AS kept_active, "
    f"(SELECT count(*) FROM rstate s WHERE s.watch = c.watch AND keep AND first_seen >= TIMESTAMP '{OVERVIEW_AS_OF}' - INTERVAL 24 HOURS) AS new_today, "
    f"(SELECT count(*) FROM rstate s WHERE s.watch = c.watch AND review = 'starred' AND status = 'active') AS starred FROM cfg c",
    "rstate", "scans", "cfg"))
def watch_overview(spark, sf):
    out = rp.watch_overview(reviewed_state(spark, sf), fr.scans(spark, sf), fr.watches(spark), F.lit(OVERVIEW_AS_OF).cast("timestamp"))
    return out.withColumn("last_scan", fr.text(F.col("last_scan")))


@query("scan_counters", compose(
    "SELECT x.watch, x.source, strftime(x.scan_id, '%Y-%m-%d') AS scan, count(f.rn2) AS fetched, count(f.rn2) FILTER (f.event = 'new') AS new, "
    "count(f.rn2) FILTER (s.keep) AS kept, count(f.rn2) FILTER (NOT s.keep) AS rejected, count(f.alert) AS notified, "
    "(SELECT count(*) FROM (SELECT g.*, lead(g.thru - CAST(g.complete AS INTEGER)) OVER (PARTITION BY watch, source, listing_id ORDER BY rn2) AS until "
    " FROM fold g) r WHERE r.watch = x.watch AND r.source = x.source AND x.complete AND r.merged IN ('active', 'pending') AND r.thru + 2 = x.thru "
    " AND (r.until IS NULL OR r.until >= x.thru)) AS gone, "
    "least(count(f.rn2) FILTER (f.event = 'new' AND s.keep), CASE x.source WHEN 'lbc' THEN 12 WHEN 'ebay' THEN 20 WHEN 'vinted' THEN 12 ELSE 15 END) AS enriched "
    "FROM scans x LEFT JOIN fold f ON f.watch = x.watch AND f.source = x.source AND f.scan_id = x.scan_id "
    "LEFT JOIN seq s ON s.watch = f.watch AND s.source = f.source AND s.listing_id = f.listing_id AND s.rn2 = f.rn2 "
    "GROUP BY x.watch, x.source, x.scan_id, x.complete, x.thru", "fold", "scans"))
def scan_counters(spark, sf):
    lines = fr.lines(spark, sf, fr.ALERTING)
    out = rp.scan_counters(lines, al.alert_rows(al.fold_alerts(lines)), fr.scans(spark, sf), BUDGETS)
    return out.withColumn("scan", fr.text(F.col("scan_id"))).drop("scan_id")


@query("distinct_watches", compose("SELECT DISTINCT watch FROM obs", "obs"))
def distinct_watches(spark, sf):
    return rp.distinct_watches(fr.state(spark, sf, with_alerts=False))


_SEARCH = ("keep AND status = 'active' AND source = 'lbc' AND suspicious = '' AND "
           "(title ILIKE '%Brand#1%' OR model ILIKE '%Brand#1%' OR family ILIKE '%Brand#1%' OR seller_name ILIKE '%Brand#1%' "
           "OR location ILIKE '%Brand#1%' OR note ILIKE '%Brand#1%')")


@query("listing_search", compose(
    f"SELECT 'text' AS search, watch, source, listing_id, unit_cents, review, note FROM rstate WHERE {_SEARCH} UNION ALL "
    "SELECT 'unreviewed', watch, source, listing_id, unit_cents, review, note FROM rstate WHERE watch = 'STANDARD' AND review = '' UNION ALL "
    "SELECT 'starred', watch, source, listing_id, unit_cents, review, note FROM rstate WHERE NOT keep AND review = 'starred' AND status = 'gone'",
    "rstate"))
def listing_search(spark, sf):
    state = reviewed_state(spark, sf, "title", "model", "family", "seller_name", "location")
    found = [
        rp.listing_search(state, source="lbc", search="brand#1", include_suspicious=False).withColumn("search", F.lit("text")),
        rp.listing_search(state, watch="STANDARD", status="", keep="", review="none").withColumn("search", F.lit("unreviewed")),
        rp.listing_search(state, status="gone", keep="0", review="starred").withColumn("search", F.lit("starred")),
    ]
    return mg.union_frames(*[f.select("search", *KEY, "unit_cents", "review", "note") for f in found])


@query("listing_page", compose(
    "SELECT watch, source, listing_id, unit_cents, (SELECT count(*) FROM state WHERE watch <> 'PROMO') AS total FROM state "
    "WHERE watch <> 'PROMO' ORDER BY unit_cents NULLS FIRST, first_seen DESC, watch, source, listing_id LIMIT 1000", "state"))
def listing_page(spark, sf):
    rows = rp.listing_search(fr.stored_state(spark, sf), status="", keep="").where(F.col("watch") != "PROMO")
    return rp.listing_page(rows).select(*KEY, "unit_cents", "total")


@query("listing_sort_any", compose("SELECT watch, source, listing_id, model, unit_cents FROM state ORDER BY model NULLS FIRST", "state"))
def listing_sort_any(spark, sf):
    return rp.listing_sort_any(fr.state(spark, sf, with_alerts=False, columns=("model",)), "model").select(*KEY, "model", "unit_cents")


@query("scan_topn_budget", compose(
    "SELECT watch, source, strftime(scan_id, '%Y-%m-%d') AS scan, listing_id, obs_id, pos AS position, n AS candidates, n <= b AS complete FROM "
    "(SELECT *, row_number() OVER (PARTITION BY watch, source, scan_id ORDER BY seen_at, listing_id, obs_id) AS pos, "
    "count(*) OVER (PARTITION BY watch, source, scan_id) AS n, CASE source WHEN 'lbc' THEN 12 WHEN 'ebay' THEN 20 WHEN 'vinted' THEN 12 ELSE 15 END AS b "
    "FROM merged) WHERE pos <= b", "merged"))
def scan_topn_budget(spark, sf):
    chosen, totals = mg.scan_topn_budget(mg.merge_scan(fr.log(spark, sf)).select(*KEY, "scan_id", "seen_at", "obs_id"), BUDGETS)
    out = chosen.join(totals, ["watch", "source", "scan_id"])
    return out.select("watch", "source", fr.text(F.col("scan_id")).alias("scan"), "listing_id", "obs_id",
                      F.col("position").cast("bigint").alias("position"), "candidates", "complete")


# ---------------------------------------------------------------- page logs

@query("page_dedup", compose(
    "SELECT strftime(scan_id, '%Y-%m-%d') AS scan, url, page_id FROM (SELECT scan_id, url, obs_id AS page_id, row_number() OVER "
    "(PARTITION BY scan_id, url ORDER BY seen_at, obs_id) AS rn FROM log) WHERE rn = 1", "log"))
def page_dedup(spark, sf):
    pages = fr.observation_log(spark, sf).select("scan_id", "url", F.col("seen_at").alias("fetched_at"), F.col("obs_id").alias("page_id"))
    return mg.page_dedup(pages).select(fr.text(F.col("scan_id")).alias("scan"), "url", "page_id")


@query("page_dedup_topics", compose(
    "SELECT n.url, n.posted_at FROM (SELECT DISTINCT url, CASE WHEN source = 'vinted' THEN '' ELSE CAST(seen_at - to_days(CAST(age_days AS INTEGER)) AS VARCHAR) END AS posted_at "
    "FROM log WHERE scan_id >= DATE '1999-01-01') n WHERE n.posted_at = '' OR NOT EXISTS (SELECT 1 FROM log o WHERE o.scan_id < DATE '1999-01-01' AND o.url = n.url "
    "AND CAST(o.seen_at - to_days(CAST(o.age_days AS INTEGER)) AS VARCHAR) = n.posted_at)", "log"))
def page_dedup_topics(spark, sf):
    posted = F.when(F.col("source") == "vinted", "").otherwise(F.concat(F.substring("posted_at", 1, 10), F.lit(" 00:00:00")))
    rows = fr.observation_log(spark, sf).select("scan_id", "url", posted.alias("last_post"))
    cut = F.lit("1999-01-01").cast("date")
    topics = rows.where(F.col("scan_id") >= cut).select("url", "last_post").distinct()
    return mg.topics_to_read(topics, rows.where(F.col("scan_id") < cut)).select("url", F.col("last_post").alias("posted_at"))


@query("scan_completeness", compose(
    "SELECT strftime(scan_id, '%Y-%m-%d') AS scan, watch, source, count(*) AS pages, count(*) FILTER (bad) AS errors, "
    "NOT bool_or(bad OR none) AS complete FROM (SELECT *, tax = 8 AND disc > 6 OR ln = 7 AND disc = 10 AS bad, "
    "CASE WHEN source = 'hfr' THEN qty = 1 AND ln = 1 WHEN source = 'vinted' THEN qty = 1 AND ln = 1 AND 1 + ln % 3 = 1 ELSE FALSE END AS none FROM obs "
    "WHERE 1 + ln % 3 <= 1 + size % 3) GROUP BY ALL", "obs"))
def scan_completeness(spark, sf):
    line = fr.table(spark, sf, "lineitem")
    part = fr.table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    ln = F.col("l_linenumber")
    tax, disc = F.round(F.col("l_tax") * 100).cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    pages = line.join(part, line.l_partkey == part.p_partkey).select(
        F.trunc(F.to_date("l_shipdate"), "month").alias("scan_id"), F.col("p_type").alias("watch"),
        fr.source_name(F.col("l_suppkey")).alias("source"), (ln % 3 + 1).alias("page_no"), (F.col("p_size") % 3 + 1).alias("max_pages"),
        F.when((ln == 7) & (disc == 10), 429).otherwise(200).alias("http_status"), (~((tax == 8) & (disc > 6))).alias("parsed"),
        F.when(ln == 1, F.col("l_quantity") - 1).otherwise(F.col("l_quantity")).cast("bigint").alias("items"))
    out = he.scan_completeness(pages)
    return out.withColumn("scan", fr.text(F.col("scan_id"))).drop("scan_id")


# ---------------------------------------------------------------- source health

FETCHES = f"""SELECT event_id, ts, {SOURCE_SQL.format('user_id')} AS source, event_type <> 'error' AS ok,
  CASE WHEN event_type = 'error' THEN 'HTTP 403 ' || props END AS error FROM events"""
CTES["fetches"] = FETCHES
DEPS["fetches"] = []


def fetch_log(spark, sf):
    e = fr.table(spark, sf, "events")
    bad = F.col("event_type") == "error"
    return e.select(F.col("event_id").alias("fetch_id"), F.col("ts").cast("timestamp").alias("ts"),
                    fr.source_name(F.col("user_id")).alias("source"), (~bad).alias("ok"),
                    F.when(bad, F.concat(F.lit("HTTP 403 "), F.col("props"))).alias("error"))


def _second(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


@query("source_health", compose(
    "SELECT source, count(*) FILTER (NOT ok AND (ts, event_id) > last_ok_key) AS failures, "
    f"strftime(max(ts) FILTER (NOT ok AND (ts, event_id) > last_ok_key) + INTERVAL {COOLDOWN_HOURS} HOURS, '%Y-%m-%d %H:%M:%S') AS blocked_until, "
    "strftime(max(ts) FILTER (ok), '%Y-%m-%d %H:%M:%S') AS last_ok, substr(last(error ORDER BY ts, event_id) FILTER (NOT ok), 1, 500) AS last_error "
    "FROM (SELECT *, max(CASE WHEN ok THEN (ts, event_id) END) OVER (PARTITION BY source) AS last_ok_key FROM fetches) GROUP BY source", "fetches"))
def source_health(spark, sf):
    out = he.source_health(fetch_log(spark, sf), COOLDOWN_HOURS)
    return out.withColumns({c: _second(F.col(c)) for c in ("blocked_until", "last_ok")})


@query("source_cooldown", compose(
    "SELECT source, strftime(slot_start, '%Y-%m-%d %H:%M:%S') AS slot_start, coalesce(NOT okb AND tsb + INTERVAL 12 HOURS > slot_start, FALSE) AS paused, "
    "CASE WHEN NOT okb AND tsb + INTERVAL 12 HOURS > slot_start THEN strftime(tsb + INTERVAL 12 HOURS, '%Y-%m-%d %H:%M:%S') END AS blocked_until FROM ("
    "SELECT s.source, s.slot_start, (SELECT last(ok ORDER BY ts, event_id) FROM fetches f WHERE f.source = s.source AND f.ts < s.slot_start) AS okb, "
    "(SELECT max(ts) FROM fetches f WHERE f.source = s.source AND f.ts < s.slot_start) AS tsb "
    "FROM (SELECT DISTINCT source, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS slot_start FROM fetches) s)", "fetches"))
def source_cooldown(spark, sf):
    out = he.source_cooldown(fetch_log(spark, sf))
    return out.withColumns({c: _second(F.col(c)) for c in ("slot_start", "blocked_until")})


@query("degraded_message", compose(
    f"SELECT source, strftime(d, '%Y-%m-%d') AS local_day, 'Veille annonces : ' || {SRC_LABEL_SQL} || ' bloqué' AS title, "
    f"CASE WHEN source = 'lbc' THEN {SRC_LABEL_SQL} || ' a répondu par un blocage (' || error || '). Source mise en pause 12 h.' || chr(10) || "
    f"'Mode dégradé : activer « Sauvegarder la recherche » sur leboncoin pour recevoir leurs alertes mail.' "
    f"ELSE {SRC_LABEL_SQL} || ' indisponible (' || error || '). Source mise en pause 12 h.' END AS message FROM (SELECT source, "
    "CAST(ts + INTERVAL 1 HOUR AS DATE) AS d, first(error ORDER BY ts, event_id) AS error FROM fetches WHERE NOT ok GROUP BY 1, 2)", "fetches"))
def degraded_message(spark, sf):
    out = he.degraded_messages(fetch_log(spark, sf), SOURCE_LABELS, cooldown_hours=COOLDOWN_HOURS)
    return out.withColumn("local_day", fr.text(F.col("local_day")))


# ---------------------------------------------------------------- unions, backfill, configuration, what-if

@query("union_watches", compose("SELECT watch, source, listing_id, obs_id, tier FROM decided_log", "decided_log"))
def union_watches(spark, sf):
    """All watches at once: their rules are rows, so the log is read once whatever their number."""
    rows = fr.log(spark, sf).where(F.col("watch").isin(*WATCHES))
    return sc.with_decision(rows, fr.watches(spark)).select(*KEY, "obs_id", "tier")


@query("schema_backfill", compose(
    "SELECT CASE WHEN obs_id % 2 = 0 THEN 'hdd' ELSE watch END AS watch, source, listing_id, obs_id, unit_cents, '' AS review, '' AS note, "
    "CAST(NULL AS VARCHAR) AS attrs FROM priced_log", "priced_log"))
def schema_backfill(spark, sf):
    new = fr.log(spark, sf).select(*KEY, "obs_id", "unit_cents", F.lit("").alias("review"), F.lit("").alias("note"),
                                   F.lit(None).cast("string").alias("attrs"))
    old = fr.log(spark, sf).select(F.when(F.col("obs_id") % 2 == 1, F.col("watch")).alias("watch"), "source", "listing_id", "obs_id",
                                   "unit_cents")
    return mg.schema_backfill(mg.schema_backfill(old, new, "hdd"), new, "other")


@query("watch_config_resolve", """
  WITH w AS (SELECT p_type || '/' || p_brand AS watch, min(p_partkey) AS k, max(p_size) AS top, min(p_size) AS low FROM part GROUP BY 1),
  r AS (SELECT CAST(avg(p_size) AS BIGINT) AS pct, CAST(max(p_size) AS BIGINT) AS days, 'separate' AS mode, '1100,2200' AS tiers FROM part),
  own AS (SELECT DISTINCT p_type || '/' || p_brand AS watch, p_partkey % 6 AS source FROM part),
  shared AS (SELECT s_suppkey % 5 AS source, count(*) AS pages, CAST(min(s_nationkey) AS BIGINT) AS delay FROM supplier GROUP BY 1)
  SELECT w.watch, w.watch AS title, CASE WHEN k % 3 = 0 THEN r.pct ELSE k % 9 END AS price_drop_pct,
    CASE WHEN k % 2 = 0 THEN r.days ELSE CAST(top AS BIGINT) END AS max_age_days, CASE WHEN k % 5 = 0 THEN 'never' ELSE r.mode END AS suspicious_mode,
    CASE WHEN k % 7 = 0 THEN CAST(top AS VARCHAR) ELSE r.tiers END AS thresholds, own.source, shared.pages,
    CASE WHEN own.source = 2 THEN 99 ELSE shared.delay END AS delay
  FROM w CROSS JOIN r JOIN own ON own.watch = w.watch JOIN shared ON shared.source = own.source
  WHERE k % 11 <> 0 AND own.source <> 4""")
def watch_config_resolve(spark, sf):
    part, supplier = fr.table(spark, sf, "part"), fr.table(spark, sf, "supplier")
    name = F.concat_ws("/", "p_type", "p_brand")
    k = F.min("p_partkey")
    watches = part.groupBy(name.alias("watch")).agg(k.alias("k"), F.max("p_size").cast("bigint").alias("top")).select(
        "watch", F.lit(None).cast("string").alias("title"), (F.col("k") % 11 != 0).alias("enabled"),
        F.when(F.col("k") % 3 != 0, F.col("k") % 9).alias("price_drop_pct"), F.when(F.col("k") % 2 != 0, F.col("top")).alias("max_age_days"),
        F.when(F.col("k") % 5 == 0, "never").alias("suspicious_mode"), F.when(F.col("k") % 7 == 0, F.col("top").cast("string")).alias("thresholds"))
    root = part.agg(F.round(F.avg("p_size")).cast("bigint").alias("price_drop_pct"), F.max("p_size").cast("bigint").alias("max_age_days"),
                    F.lit("separate").alias("suspicious_mode"), F.lit("1100,2200").alias("thresholds"))
    own = part.select(name.alias("watch"), (F.col("p_partkey") % 6).alias("source")).distinct().select(
        "watch", "source", F.lit(True).alias("enabled"), F.lit(None).cast("bigint").alias("pages"),
        F.when(F.col("source") == 2, F.lit(99)).cast("bigint").alias("delay"))
    shared = supplier.groupBy((F.col("s_suppkey") % 5).alias("source")).agg(
        F.count("*").alias("pages"), F.min("s_nationkey").cast("bigint").alias("delay")).withColumn("enabled", F.col("source") != 4)
    resolved = cf.require_watch(cf.resolve_watch_sections(root, watches, ["price_drop_pct", "max_age_days", "suspicious_mode", "thresholds"]))
    sections = cf.resolve_source_sections(shared, own, ["pages", "delay"], [])
    return resolved.join(sections, "watch")


DRAFT = {name: {**w, "thresholds": [{"max_cents": 150000, "priority": "urgent"}, {"max_cents": 250000, "priority": "low"}]}
         for name, w in WATCHES.items()}


@query("dry_run_evaluate", compose(
    "SELECT watch, source, listing_id, obs_id, unit_cents, keep AS keep_now, tier AS tier_now, "
    "CASE WHEN unit_cents > 250000 THEN FALSE WHEN stage = 'over_cap' THEN NOT (min_unit > 0 AND unit_cents < min_unit) AND NOT coalesce(max_age > 0 AND age_days > max_age, FALSE) "
    "AND NOT coalesce(req_delivery AND delivery = FALSE, FALSE) ELSE keep END AS keep_draft, "
    "CASE WHEN verdict <> 'accept' THEN 'reject' WHEN NOT (CASE WHEN unit_cents > 250000 THEN FALSE WHEN stage = 'over_cap' THEN NOT (min_unit > 0 AND unit_cents < min_unit) "
    "AND NOT coalesce(max_age > 0 AND age_days > max_age, FALSE) AND NOT coalesce(req_delivery AND delivery = FALSE, FALSE) ELSE keep END) THEN 'ignore' "
    "WHEN unit_cents <= 150000 THEN 'urgent' ELSE 'low' END AS tier_draft FROM decided_log", "decided_log"))
def dry_run_evaluate(spark, sf):
    draft = watch_frame(spark, DRAFT, PROFILES)
    return rp.compare_settings(fr.log(spark, sf), fr.watches(spark), draft).select(
        *KEY, "obs_id", "unit_cents", "keep_now", "tier_now", "keep_draft", "tier_draft")


@query("sink_state", compose(
    "SELECT watch, source, listing_id, status, unit_cents FROM state", "state"))
def sink_state(spark, sf):
    """The snapshot as written and read back from the shared folder."""
    from pricelens.session import shared_folder
    from pricelens.sources.sinks import sink_state as write

    path = shared_folder(spark, "state")
    state = fr.state(spark, sf, with_alerts=False, columns=("model", "family"))
    last = state.select(*KEY, F.col("last_scan_id").alias("scan_id"))
    write(hi.with_last_facts(state, fr.facts_of(spark, sf, last)), path)
    return spark.read.parquet(path).select(*KEY, "status", "unit_cents")


@query("sink_history", compose("SELECT watch, source, listing_id, obs_id, unit_cents FROM history", "history"))
def sink_history(spark, sf):
    from pricelens.session import shared_folder
    from pricelens.sources.sinks import sink_history as append

    path = shared_folder(spark, "history")
    append(fr.history(spark, sf, ("price_cents", "model", "family")), path)
    return spark.read.parquet(path).select(*KEY, "obs_id", "unit_cents")


@query("sink_alerts", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, alert AS event, unit_cents FROM fold WHERE alert IS NOT NULL", "fold"))
def sink_alerts(spark, sf):
    from pricelens.session import shared_folder
    from pricelens.sources.sinks import sink_alerts as append

    path = shared_folder(spark, "alerts")
    append(al.alert_rows(al.fold_alerts(fr.lines(spark, sf))), path)
    return spark.read.parquet(path).select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "event", "unit_cents")

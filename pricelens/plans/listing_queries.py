"""Queries over the observation log: prices, scoring, market, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelens.functions import listing as li
from pricelens.operators import history as hi
from pricelens.operators import market as mk
from pricelens.operators import merging as mg
from pricelens.operators import scoring as sc
from pricelens.plans import frames as fr
from pricelens.plans.oracle import SCAM, SCORED_TEMPLATE, compose
from pricelens.plans.registry import query

IDS = ["watch", "source", "listing_id", "obs_id"]
KEY = ["watch", "source", "listing_id"]


@query("delivered_price", compose("SELECT watch, source, listing_id, obs_id, delivered_cents FROM log", "log"))
def delivered_price(spark, sf):
    return fr.log(spark, sf).select(*IDS, "delivered_cents")


@query("unit_price", compose("SELECT watch, source, listing_id, obs_id, unit_cents FROM priced_log", "priced_log"))
def unit_price(spark, sf):
    return fr.log(spark, sf).select(*IDS, "unit_cents")


@query("per_unit", compose(
    "SELECT p.watch, source, listing_id, obs_id, CASE WHEN divisor > 0 THEN (2 * unit_cents + divisor) // (2 * divisor) END "
    "AS per_unit_cents, CASE WHEN divisor > 0 THEN replace(regexp_replace(printf('%.2f', ((2 * unit_cents + divisor) // "
    "(2 * divisor)) / 100.0), '[.]00$', ''), '.', ',') || ' ' || unit_label ELSE '' END AS per_unit_text "
    "FROM priced_log p JOIN cfg c ON p.watch = c.watch", "priced_log", "cfg"))
def per_unit(spark, sf):
    from pricelens.functions.money import format_per_unit

    df = fr.log(spark, sf).join(F.broadcast(fr.watches(spark)), "watch")
    cents = sc.per_unit_cents(F.col("unit_cents"), F.col("unit_divisor"))
    return df.select(*IDS, cents.alias("per_unit_cents"), format_per_unit(cents, F.col("unit_label")).alias("per_unit_text"))


@query("tier_assign", compose("SELECT watch, source, listing_id, obs_id, unit_cents, keep, tier, tags FROM decided_log",
                              "decided_log"))
def tier_assign(spark, sf):
    df = sc.with_decision(fr.log(spark, sf), fr.watches(spark))
    return df.select(*IDS, "unit_cents", "keep", "tier", F.array_join("tags", ",").alias("tags"))


def _stage_sql(stage: str) -> str:
    return compose(f"SELECT watch, source, listing_id, obs_id, unit_cents FROM decided_log WHERE stage = '{stage}'",
                   "decided_log")


def _stage_query(stage: str):
    def run(spark, sf):
        df = sc.with_decision(fr.log(spark, sf), fr.watches(spark))
        return df.where(F.col("stage") == stage).select(*IDS, "unit_cents")

    return run


for _name, _stage in (("floor_filter", "below_floor"), ("age_filter", "too_old"), ("delivery_filter", "no_delivery")):
    query(_name, _stage_sql(_stage))(_stage_query(_stage))


@query("priority_downgrade", compose(
    "SELECT watch, source, listing_id, obs_id, tier, priority FROM decided_log WHERE keep AND tier <> priority", "decided_log"))
def priority_downgrade(spark, sf):
    df = sc.with_decision(fr.log(spark, sf), fr.watches(spark))
    return df.where(F.col("keep") & (F.col("tier") != F.col("priority"))).select(*IDS, "tier", "priority")


_ASK = "demander la référence exacte"
NOTES_SQL = f"""concat_ws('|',
  CASE WHEN quantity > 1 AND f_multi THEN 'lot mixte de ' || quantity || ' articles, prix total non divisé' END,
  CASE WHEN shipping_cents IS NULL THEN 'port inconnu' WHEN shipping_estimated THEN 'port estimé' END,
  CASE stage WHEN 'below_floor' THEN 'sous le prix plancher (' || (min_unit + 50) // 100 || ' €) : accessoire ou annonce factice'
    WHEN 'too_old' THEN 'annonce publiée il y a ' || age_days || ' jours' WHEN 'no_delivery' THEN 'pas de livraison' END,
  CASE WHEN keep AND (f_unknown OR f_refmiss) THEN '{_ASK}' || CASE WHEN profile = 'hdd' THEN ' et une capture SMART' ELSE '' END END,
  CASE WHEN keep AND f_unver THEN 'référence hors catalogue : vérifier avant d''acheter' END,
  CASE WHEN keep AND f_low THEN 'gamme inférieure' END,
  CASE WHEN keep AND div > 1 THEN 'lot de ' || div || ' : ' || (delivered_cents + 50) // 100 || ' € au total' END,
  CASE WHEN keep AND f_multi THEN 'plusieurs capacités citées' END)"""


@query("decision_notes", compose(f"SELECT watch, source, listing_id, obs_id, {NOTES_SQL} AS notes FROM decided_log", "decided_log"))
def decision_notes(spark, sf):
    df = sc.with_decision(fr.log(spark, sf), fr.watches(spark))
    return df.select(*IDS, fr.joined(F.col("notes")).alias("notes"))


@query("listing_age_days", compose("SELECT watch, source, listing_id, obs_id, age_days FROM log", "log"))
def listing_age_days(spark, sf):
    df = fr.observation_log(spark, sf)
    return df.select(*IDS, li.age_days(F.col("posted_at"), F.col("seen_at")).alias("age_days"))


@query("condition_code", compose(
    "SELECT watch, source, listing_id, obs_id, CASE WHEN source = 'ebay' THEN CASE condition_id WHEN '1000' THEN 'new' "
    "WHEN '2010' THEN 'refurb' WHEN '3000' THEN 'used' WHEN '7000' THEN 'parts' ELSE 'unknown' END "
    "WHEN condition = 'Neuf' THEN 'new' WHEN condition = '' THEN 'unknown' "
    "WHEN condition = 'Pour pièces' AND source = 'lbc' THEN 'parts' ELSE 'used' END AS condition_code FROM log", "log"))
def condition_code(spark, sf):
    label = F.col("condition")
    code = F.when(F.col("source") == "ebay", li.condition_from_id(F.col("condition_id"))).when(
        F.col("source") == "lbc", li.condition_from_label(label)).otherwise(li.condition_from_label(label, False))
    return fr.observation_log(spark, sf).select(*IDS, code.alias("condition_code"))


WEIGHT_STEPS = [(1000, 550), (2000, 690), (5000, 990), (10000, 1390)]


@query("shipping_estimate", """
    SELECT l_orderkey, l_linenumber, l_partkey, w AS weight_g, CAST(CASE WHEN w = 0 OR w > 10000 THEN 690 WHEN w <= 1000 THEN 550
      WHEN w <= 2000 THEN 690 WHEN w <= 5000 THEN 990 ELSE 1390 END AS BIGINT) AS shipping_cents
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, (CAST(l_quantity AS BIGINT) - 1) * 250 AS w FROM lineitem)""")
def shipping_estimate(spark, sf):
    weight = (F.col("l_quantity").cast("bigint") - 1) * 250
    return fr.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", weight.alias("weight_g"),
        li.weight_shipping_cents(weight, WEIGHT_STEPS, 690).alias("shipping_cents"))


@query("listing_label", compose(
    "SELECT watch, source, listing_id, obs_id, CASE WHEN family IS NOT NULL AND model IS NOT NULL THEN family || ' ' || model "
    "WHEN family IS NOT NULL THEN family || ' (réf. ?)' WHEN model IS NOT NULL THEN model WHEN brand IS NOT NULL THEN "
    "brand || ' modèle inconnu' ELSE 'Modèle inconnu' END AS label FROM log", "log"))
def listing_label(spark, sf):
    return fr.observation_log(spark, sf).select(
        *IDS, li.listing_label(F.col("family"), F.col("model"), F.col("brand")).alias("label"))


@query("source_predicates", compose(
    "SELECT watch, source, listing_id, obs_id, price_cents FROM log WHERE price_cents BETWEEN 60000 AND 400000 "
    "AND (source <> 'ebay' OR condition_id IN ('1000', '2010', '3000')) AND delivery AND status = 'active'", "log"))
def source_predicates(spark, sf):
    from pricelens.operators.reports import source_predicates as run

    return run(fr.observation_log(spark, sf), 60000, 400000, ["1000", "2010", "3000"]).select(*IDS, "price_cents")


@query("status_rank", compose(
    "SELECT watch, source, listing_id, obs_id, CASE WHEN (CASE prev WHEN 'sold' THEN 3 WHEN 'pending' THEN 2 WHEN 'gone' THEN 1 "
    "ELSE 0 END) >= (CASE status WHEN 'sold' THEN 3 WHEN 'pending' THEN 2 WHEN 'gone' THEN 1 ELSE 0 END) THEN prev ELSE status "
    "END AS worst FROM (SELECT *, CASE WHEN obs_id % 4 = 0 THEN 'gone' WHEN obs_id % 4 = 1 THEN 'pending' ELSE 'active' END "
    "AS prev FROM log)", "log"))
def status_rank(spark, sf):
    bucket = F.col("obs_id") % 4
    prev = F.when(bucket == 0, "gone").when(bucket == 1, "pending").otherwise("active")
    return fr.observation_log(spark, sf).select(*IDS, li.worst_status(prev, F.col("status")).alias("worst"))


# ---------------------------------------------------------------- merging

def _merge_sql(order: str, worst: bool = False) -> str:
    status = ("CASE max(CASE status WHEN 'sold' THEN 3 WHEN 'pending' THEN 2 ELSE 0 END) OVER k WHEN 3 THEN 'sold' WHEN 2 "
              "THEN 'pending' ELSE 'active' END" if worst else "status")
    desc = ("coalesce(first_value(nullif(description, '') IGNORE NULLS) OVER (PARTITION BY watch, source, scan_id, listing_id "
            "ORDER BY seen_at, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), description)"
            if worst else "description")
    return compose(
        f"SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, obs_id, delivered_cents, st AS status, de AS description "
        f"FROM (SELECT *, {status} AS st, {desc} AS de, row_number() OVER (PARTITION BY watch, source, scan_id, listing_id "
        f"ORDER BY {order}) AS rn FROM log WINDOW k AS (PARTITION BY watch, source, scan_id, listing_id)) WHERE rn = 1", "log")


def _merge_query(op):
    def run(spark, sf):
        cols = ["watch", "source", "scan_id", "listing_id", "seen_at", "obs_id", "delivered_cents", "status", "description"]
        return op(fr.log(spark, sf).select(*cols)).select(
            *KEY, fr.text(F.col("scan_id")).alias("scan"), "obs_id", "delivered_cents", "status", "description")

    return run


query("merge_pages_first", _merge_sql("seen_at, obs_id"))(_merge_query(mg.merge_pages_first))
query("merge_pages_cheapest", _merge_sql("delivered_cents, seen_at, obs_id"))(_merge_query(mg.merge_pages_cheapest))
query("merge_pages_worst_status", _merge_sql("seen_at, obs_id", True))(_merge_query(mg.merge_pages_worst_status))


@query("union_sources", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, obs_id, status, delivered_cents FROM merged", "merged"))
def union_sources(spark, sf):
    df = mg.merge_scan(fr.log(spark, sf))
    return df.select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "obs_id", "status", "delivered_cents")


# ---------------------------------------------------------------- state

@query("status_timeline", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, merged AS status, coalesce(prev_status, '') AS prev_status "
    "FROM fold", "fold"))
def status_timeline(spark, sf):
    return fr.lines(spark, sf).select(*KEY, fr.text(F.col("scan_id")).alias("scan"), F.col("merged_status").alias("status"),
                                      F.coalesce("prev_status", F.lit("")).alias("prev_status"))


@query("price_events", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, event, unit_cents FROM fold", "fold"))
def price_events(spark, sf):
    return hi.price_events(fr.lines(spark, sf)).select(*KEY, fr.text(F.col("scan_id")).alias("scan"), "event", "unit_cents")


@query("missed_scan_runs", compose(
    "SELECT watch, source, listing_id, strftime(scan_id, '%Y-%m-%d') AS scan, after AS missed_after, "
    "CAST(CASE WHEN merged IN ('active', 'pending') THEN least(after, 2) ELSE 0 END AS BIGINT) AS missed_scans, "
    "merged IN ('active', 'pending') AND after >= 2 AS gone FROM (SELECT f.*, (SELECT CAST(count(*) AS BIGINT) FROM scans x "
    "WHERE x.watch = f.watch AND x.source = f.source AND x.complete AND x.scan_id > f.scan_id AND x.scan_id < f.next_scan) AS after "
    "FROM (SELECT *, coalesce(lead(scan_id) OVER (PARTITION BY watch, source, listing_id ORDER BY scan_id), DATE '2999-01-01') "
    "AS next_scan FROM fold) f)", "fold", "scans"))
def missed_scan_runs(spark, sf):
    df = hi.missed_scan_runs(fr.lines(spark, sf), fr.scans(spark, sf))
    return df.select(*KEY, fr.text(F.col("scan_id")).alias("scan"), F.col("missed_after").cast("bigint").alias("missed_after"),
                     F.col("missed_scans").cast("bigint").alias("missed_scans"), "gone")


STATE_OUT = ("watch, source, listing_id, obs_id, unit_cents, status, seen_status, strftime(first_seen, '%Y-%m-%d') AS first_seen, "
             "strftime(seen_at, '%Y-%m-%d') AS last_seen, CAST(missed_scans AS BIGINT) AS missed_scans, keep, tier, suspicious, "
             "notified AS notified_cents, CAST(notify_count AS BIGINT) AS notify_count")


def state_columns(df):
    return df.select(*KEY, "obs_id", "unit_cents", "status", "seen_status", fr.text(F.col("first_seen")).alias("first_seen"),
                     fr.text(F.col("last_seen")).alias("last_seen"), "missed_scans", "keep", "tier",
                     fr.joined(F.col("suspicious")).alias("suspicious"), "notified_cents", "notify_count")


@query("state_merge", compose(f"SELECT {STATE_OUT} FROM state", "state"))
def state_merge(spark, sf):
    """Snapshot after the scans before 1998, then the later scans merged onto it."""
    from pricelens.operators.snapshots import advance_state

    rows, scans = fr.scored_scan_rows(spark, sf, [c for c in fr.SHOWN if c not in fr.SETTINGS]), fr.scans(spark, sf)
    settings = fr.watches(spark)
    cut = F.lit("1998-01-01").cast("date")
    before = advance_state(None, rows.where(F.col("scan_id") < cut), scans.where(F.col("scan_id") < cut), settings=settings)
    after = advance_state(before, rows.where(F.col("scan_id") >= cut), scans, settings=settings)
    return state_columns(after)


@query("missing_listings", compose(
    "SELECT DISTINCT s.watch, s.source, s.listing_id, s.unit_cents FROM (SELECT f.watch, f.source, f.listing_id, f.unit_cents, f.merged, f.thru, "
    "row_number() OVER (PARTITION BY watch, source, listing_id ORDER BY scan_id DESC) AS back FROM fold f WHERE scan_id < DATE '2001-06-01') s "
    "JOIN (SELECT watch, source, max(thru) AS total FROM scans WHERE scan_id < DATE '2001-06-01' GROUP BY ALL) t USING (watch, source) "
    "JOIN scans c ON c.watch = s.watch AND c.source = s.source AND c.scan_id = DATE '2001-06-01' AND c.complete "
    "WHERE back = 1 AND s.merged IN ('active', 'pending') AND t.total - s.thru < 2 AND NOT EXISTS (SELECT 1 FROM merged m "
    "WHERE m.watch = s.watch AND m.source = s.source AND m.listing_id = s.listing_id AND m.scan_id = DATE '2001-06-01')", "fold", "scans"))
def missing_listings(spark, sf):
    rows, scans = fr.scored_scan_rows(spark, sf, ()), fr.scans(spark, sf)
    scan = F.lit("2001-06-01").cast("date")
    earlier = scans.where(F.col("scan_id") < scan)
    state = hi.snapshot(hi.timeline(rows.where(F.col("scan_id") < scan), earlier), earlier, False)
    missing = hi.missing_listings(state, rows.where(F.col("scan_id") == scan), scans.where(F.col("scan_id") == scan))
    return missing.select(*KEY, "unit_cents")


# ---------------------------------------------------------------- market

@query("latest_price_point", compose(
    "SELECT watch, source, listing_id, obs_id, unit_cents, strftime(seen_at, '%Y-%m-%d') AS seen_at FROM latest", "latest"))
def latest_price_point(spark, sf):
    return hi.latest_price_point(fr.history(spark, sf, ()).select(*KEY, "seen_at", "obs_id", "unit_cents")).select(*KEY, "obs_id", "unit_cents", fr.text(F.col("seen_at")).alias("seen_at"))


@query("price_history_of", compose(
    "SELECT strftime(seen_at, '%Y-%m-%d') AS seen_at, price_cents, delivered_cents, unit_cents FROM history "
    "WHERE listing_id = '7' AND source = 'lbc' ORDER BY 1", "history"))
def price_history_of(spark, sf):
    """Points of one listing: the key filter reaches the line item scan."""
    points = fr.history(spark, sf).where((F.col("listing_id") == "7") & (F.col("source") == "lbc"))
    return points.orderBy("seen_at", "obs_id").select(fr.text(F.col("seen_at")).alias("seen_at"), "price_cents",
                                                      "delivered_cents", "unit_cents")


AS_OF, DAYS = "2001-09-15", 400
POINTS = (f"SELECT p.watch, p.model, p.family, p.unit_cents FROM latest p JOIN state s USING (watch, source, listing_id) "
          f"WHERE s.keep AND s.quantity = 1 AND s.suspicious = '' AND p.unit_cents <> 0 "
          f"AND p.seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAYS")
MARKET = ("SELECT watch, 'model' AS level, model AS name, median(unit_cents) AS median_cents, count(*) AS median_samples "
          "FROM points WHERE model IS NOT NULL GROUP BY ALL UNION ALL SELECT watch, 'family', family, median(unit_cents), count(*) "
          "FROM points WHERE family IS NOT NULL GROUP BY ALL")


def market_of(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp")
    state = hi.snapshot(fr.lines(spark, sf, fr.MARKET), fr.scans(spark, sf), False)
    return mk.market_table(mk.snapshot_points(state, as_of, DAYS))


@query("market_median_history", compose("SELECT * FROM market", "latest", "state", extra={"points": POINTS, "market": MARKET}))
def market_median_history(spark, sf):
    """The same market from stored history and state tables."""
    timeline = fr.lines(spark, sf, fr.MARKET)
    state = hi.snapshot(timeline, fr.scans(spark, sf), False)
    points = hi.price_history(timeline).select(*KEY, "seen_at", "obs_id", "unit_cents", "model", "family")
    return mk.market_table(mk.market_points(points, state, F.lit(AS_OF).cast("timestamp"), DAYS))


@query("market_median", compose("SELECT * FROM market", "latest", "state", extra={"points": POINTS, "market": MARKET}))
def market_median(spark, sf):
    return market_of(spark, sf)


SCORED_MARKET = SCORED_TEMPLATE.format(
    scam=SCAM, from_="(SELECT d.*, m.median_cents AS mm, m.median_samples AS mn, f.median_cents AS fm, f.median_samples AS fn "
    "FROM decided_log d LEFT JOIN market m ON m.level = 'model' AND m.watch = d.watch AND m.name = d.model "
    "LEFT JOIN market f ON f.level = 'family' AND f.watch = d.watch AND f.name = d.family)",
    market="CASE WHEN mn IS NOT NULL THEN CASE WHEN mn >= min_samples THEN mm ELSE ref_cents END "
           "WHEN fn >= min_samples THEN fm ELSE ref_cents END")


@query("scam_flags", compose("SELECT watch, source, listing_id, obs_id, suspicious FROM judged WHERE keep", "decided_log", "latest", "state",
                             extra={"points": POINTS, "market": MARKET, "judged": SCORED_MARKET}))
def scam_flags(spark, sf):
    judged = sc.score(fr.log(spark, sf), fr.watches(spark), market_of(spark, sf))
    return judged.where("keep").select(*IDS, fr.joined(F.col("suspicious")).alias("suspicious"))


@query("rolling_market", compose(
    "SELECT h.watch, strftime(c.scan_id, '%Y-%m-%d') AS scan, h.family, median(h.unit_cents) AS median_cents, count(*) AS median_samples FROM "
    "(SELECT *, lead(seen_at) OVER (PARTITION BY watch, source, listing_id ORDER BY seen_at, obs_id) AS next_at FROM history) h "
    "JOIN state s USING (watch, source, listing_id) JOIN (SELECT DISTINCT watch, scan_id FROM scans) c ON c.watch = h.watch "
    "AND h.seen_at < c.scan_id AND h.seen_at >= c.scan_id - INTERVAL 30 DAYS AND (h.next_at IS NULL OR h.next_at >= c.scan_id) "
    "WHERE s.keep AND s.quantity = 1 AND s.suspicious = '' AND h.family IS NOT NULL AND h.unit_cents <> 0 GROUP BY ALL",
    "history", "state", "scans"))
def rolling_market(spark, sf):
    timeline, scans = fr.lines(spark, sf, ("keep", "quantity", "suspicious", "family")), fr.scans(spark, sf)
    state = hi.snapshot(timeline, scans, False)
    eligible = state.where(F.col("keep") & (F.col("quantity") == 1) & (F.size("suspicious") == 0))
    starts = scans.select("watch", "scan_id").distinct().withColumn("start_at", F.col("scan_id").cast("timestamp"))
    market = mk.rolling_market(hi.price_history(timeline), eligible, starts)
    return market.select("watch", fr.text(F.col("scan_id")).alias("scan"), "family", "median_cents", "median_samples")

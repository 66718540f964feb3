"""Plain SQL for the checked queries: shared common table expressions and a small composer."""

from __future__ import annotations

import re

from pricelens.config import watch_rows
from pricelens.operators.profiles import PROFILES
from pricelens.plans.settings import WATCHES


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def _watch_values() -> str:
    rows = []
    for w in watch_rows(WATCHES, PROFILES):
        tiers = w["tiers"] + [{"max_cents": None, "priority": None, "tags": []}] * (3 - len(w["tiers"]))
        flat = [w["watch"], w["watch_title"], w["profile"], w["enabled"], w["price_drop_pct"], w["suspicious_mode"],
                w["require_delivery"], w["max_age_days"], w["watch_label"], w["min_samples"], w["reference_cents"],
                w["min_unit_cents"], w["below_median_pct"], w["max_shipping_cents"], w["max_shipping_pct"],
                w["unit_divisor"] and int(w["unit_divisor"]), w["unit_label"]]
        for t in tiers:
            flat += [t["max_cents"], t["priority"], ",".join(t["tags"])]
        rows.append("(" + ", ".join(map(_lit, flat)) + ")")
    cols = ("watch, wtitle, profile, enabled, drop_pct, sus_mode, req_delivery, max_age, wlabel, min_samples, ref_cents, "
            "min_unit, below_pct, max_ship, max_ship_pct, divisor, unit_label, t1, p1, g1, t2, p2, g2, t3, p3, g3")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({cols})"


RANK = "CASE {0} WHEN 'sold' THEN 3 WHEN 'pending' THEN 2 WHEN 'gone' THEN 1 ELSE 0 END"
EUR0 = "CAST(CAST(floor(({0} + 50) / 100.0) AS BIGINT) AS VARCHAR)"


def eur(cents: str) -> str:
    """French price text in SQL."""
    whole = f"regexp_replace(format('{{:,}}', CAST({cents} // 100 AS BIGINT)), ',', ' ', 'g')"
    frac = f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    return (f"(CASE WHEN {cents} IS NULL THEN '?' ELSE {whole} || CASE WHEN {cents} % 100 = 0 THEN '' "
            f"ELSE ',' || {frac} END || ' €' END)")


CTES: dict[str, str] = {
    "cfg": _watch_values(),
    "obs": """
      SELECT p.p_type AS watch,
        CASE l.l_suppkey % 4 WHEN 0 THEN 'lbc' WHEN 1 THEN 'ebay' WHEN 2 THEN 'vinted' ELSE 'hfr' END AS source,
        CAST(l.l_partkey AS VARCHAR) AS listing_id,
        CAST(date_trunc('month', l.l_shipdate) AS DATE) AS scan_id,
        l.l_orderkey * 10 + l.l_linenumber AS obs_id, l.l_shipdate AS seen_at, l.l_linenumber AS ln,
        CAST(l.l_quantity AS BIGINT) AS qty, l.l_suppkey AS suppkey, p.p_size AS size, p.p_name, p.p_brand,
        CAST(round(l.l_extendedprice * 100) AS BIGINT) // CAST(l.l_quantity AS BIGINT) AS price_cents,
        CAST(round(l.l_tax * 100) AS BIGINT) AS tax, CAST(round(l.l_discount * 100) AS BIGINT) AS disc,
        l.l_returnflag AS rf, l.l_linestatus AS ls, s.s_name, s.s_nationkey, s.s_acctbal
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "log": """
      SELECT watch, source, listing_id, scan_id, obs_id, seen_at, price_cents,
        'https://market.example/' || source || '/' || listing_id AS url, p_name || ' ' || p_brand AS title,
        CASE WHEN ln % 2 = 0 THEN 'lot ' || ln ELSE '' END AS description,
        CASE WHEN tax > 0 THEN price_cents * tax // 100 END AS shipping_cents,
        source IN ('lbc', 'vinted') AND tax > 0 AS shipping_estimated,
        price_cents * disc // 100 AS fees_cents,
        price_cents + CASE WHEN tax > 0 THEN price_cents * tax // 100 ELSE 0 END + price_cents * disc // 100
          AS delivered_cents,
        CASE WHEN ln >= 6 THEN 2 ELSE 1 END AS quantity,
        CASE ln % 4 WHEN 0 THEN 'Neuf' WHEN 1 THEN 'Très bon état' WHEN 2 THEN 'Pour pièces' ELSE '' END AS condition,
        CASE ln % 5 WHEN 0 THEN '1000' WHEN 1 THEN '2010' WHEN 2 THEN '3000' WHEN 3 THEN '7000' ELSE '9999' END
          AS condition_id,
        s_name AS seller_name, CASE WHEN s_nationkey % 2 = 0 THEN 'pro' ELSE 'private' END AS seller_type,
        CASE WHEN s_acctbal >= 0 THEN 90 + suppkey % 11 END AS seller_rating,
        CASE WHEN s_acctbal >= 0 THEN CAST(floor(s_acctbal / 1000) AS BIGINT) END AS seller_reviews,
        'Ville ' || s_nationkey AS location,
        CASE WHEN ln % 5 = 0 THEN NULL WHEN ls = 'F' AND ln % 3 = 0 THEN FALSE ELSE TRUE END AS delivery,
        CASE WHEN source = 'hfr' THEN NULL ELSE ln % 3 <> 0 END AS secure_payment,
        CASE rf WHEN 'A' THEN 'pending' WHEN 'R' THEN 'sold' ELSE 'active' END AS status,
        CASE WHEN source = 'vinted' THEN NULL ELSE qty * 5 END AS age_days,
        CASE WHEN size % 10 = 0 THEN 'reject' ELSE 'accept' END AS verdict,
        CASE WHEN size % 7 NOT IN (2, 5) THEN p_name END AS model,
        CASE WHEN size % 7 <> 5 THEN p_brand END AS family,
        CASE WHEN size % 3 <> 0 THEN p_brand END AS brand,
        size % 7 = 1 AS f_multi, size % 7 = 2 AS f_refmiss, size % 7 = 3 AS f_low, size % 7 = 4 AS f_unver,
        size % 7 = 5 AS f_unknown
      FROM obs""",
    "merged": f"""
      SELECT * REPLACE (CASE WHEN source = 'lbc' THEN
          CASE worst WHEN 3 THEN 'sold' WHEN 2 THEN 'pending' WHEN 1 THEN 'gone' ELSE 'active' END ELSE status END AS status)
      FROM (SELECT *, row_number() OVER (PARTITION BY watch, source, listing_id, scan_id
                ORDER BY CASE WHEN source = 'ebay' THEN delivered_cents ELSE 0 END, seen_at, obs_id) AS rn,
              max({RANK.format('status')}) OVER (PARTITION BY watch, source, listing_id, scan_id) AS worst
            FROM log) WHERE rn = 1""",
    "priced": """
      SELECT *, (2 * delivered_cents + div) // (2 * div) AS unit_cents FROM (
        SELECT *, CASE WHEN quantity > 1 AND f_multi THEN 1 ELSE quantity END AS div FROM {src})""",
    "staged": """
      SELECT p.*, c.* EXCLUDE (watch),
        CASE WHEN verdict <> 'accept' THEN 'reject'
             WHEN unit_cents > coalesce(t3, t2, t1) THEN 'over_cap'
             WHEN min_unit > 0 AND unit_cents < min_unit THEN 'below_floor'
             WHEN max_age > 0 AND age_days > max_age THEN 'too_old'
             WHEN req_delivery AND delivery = FALSE THEN 'no_delivery' ELSE 'kept' END AS stage,
        CASE WHEN unit_cents <= t1 THEN p1 WHEN unit_cents <= t2 THEN p2 WHEN unit_cents <= t3 THEN p3 END AS tp,
        CASE WHEN unit_cents <= t1 THEN g1 WHEN unit_cents <= t2 THEN g2 WHEN unit_cents <= t3 THEN g3 END AS tg
      FROM priced p JOIN cfg c ON p.watch = c.watch""",
    "decided": """
      SELECT *, stage = 'kept' AS keep,
        CASE WHEN stage = 'reject' THEN 'reject' WHEN stage = 'kept' THEN tp ELSE 'ignore' END AS tier,
        CASE WHEN stage <> 'kept' THEN 'none' WHEN f_low OR f_unver OR f_unknown THEN 'low' ELSE tp END AS priority,
        CASE WHEN stage = 'kept' THEN tg ELSE '' END AS tags
      FROM staged""",
    "scored": """
      SELECT *, CASE WHEN NOT keep THEN '' ELSE concat_ws('|', {scam}) END AS suspicious FROM
        (SELECT *, CAST({market} AS DOUBLE) AS mkt FROM {from_})""",
    "scans": """
      SELECT *, row_number() OVER (PARTITION BY watch, source ORDER BY scan_id) AS scan_no,
        CAST(sum(CASE WHEN complete THEN 1 ELSE 0 END) OVER (PARTITION BY watch, source ORDER BY scan_id) AS BIGINT) AS thru
      FROM (SELECT DISTINCT watch, source, scan_id, (month(scan_id) + CASE source WHEN 'lbc' THEN 1 WHEN 'ebay' THEN 2
              WHEN 'vinted' THEN 3 ELSE 4 END) % 5 <> 0 AS complete FROM obs)""",
    "seq": """
      SELECT m.*, s.complete, s.thru, s.scan_no,
        row_number() OVER w AS rn2, s.thru - CAST(s.complete AS INTEGER) - lag(s.thru) OVER w AS missed
      FROM scored m JOIN scans s USING (watch, source, scan_id)
      WINDOW w AS (PARTITION BY watch, source, listing_id ORDER BY scan_id)""",
    # The listing state machine, one sighting at a time.
    "fold": f"""
      SELECT watch, source, listing_id, rn2, scan_id, seen_at, obs_id, status AS merged, CAST(NULL AS VARCHAR) AS prev_status,
        unit_cents, 'new' AS event, CAST(0 AS BIGINT) AS missed,
        CASE WHEN {{can}} THEN unit_cents END AS notified, CASE WHEN {{can}} THEN seen_at END AS notified_at,
        CASE WHEN {{can}} THEN 1 ELSE 0 END AS notify_count,
        CASE WHEN {{can}} THEN 'new' END AS alert, CAST(NULL AS BIGINT) AS prev_notified, suspicious, thru, complete
      FROM seq WHERE rn2 = 1
      UNION ALL
      SELECT watch, source, listing_id, rn2, scan_id, seen_at, obs_id, merged, prev_status, unit_cents,
        CASE WHEN unit_cents < pu THEN 'price_drop' WHEN unit_cents > pu THEN 'price_up'
             WHEN merged <> prev_status THEN 'status_change' ELSE 'unchanged' END,
        missed,
        CASE WHEN alert IS NOT NULL THEN unit_cents ELSE notified END,
        CASE WHEN alert IS NOT NULL THEN seen_at ELSE notified_at END,
        notify_count + CASE WHEN alert IS NOT NULL THEN 1 ELSE 0 END, alert, notified, suspicious, thru, complete
      FROM (SELECT *, CASE WHEN {{can2}} THEN
                CASE WHEN notified IS NULL THEN 'new' WHEN unit_cents * 100 <= notified * (100 - drop_pct) THEN 'price_drop' END
              END AS alert
            FROM (SELECT s.*, f.unit_cents AS pu, f.notified, f.notified_at, f.notify_count, f.ps AS prev_status,
                CASE WHEN f.ps = 'gone' AND s.status = 'active' THEN 'active'
                     WHEN {RANK.format('f.ps')} >= {RANK.format('s.status')} THEN f.ps ELSE s.status END AS merged
              FROM seq s JOIN (SELECT f0.*, CASE WHEN s0.missed >= 2 AND f0.merged IN ('active', 'pending') THEN 'gone'
                                  ELSE f0.merged END AS ps
                   FROM fold f0 JOIN seq s0 ON s0.watch = f0.watch AND s0.source = f0.source
                     AND s0.listing_id = f0.listing_id AND s0.rn2 = f0.rn2 + 1) f
                ON s.watch = f.watch AND s.source = f.source AND s.listing_id = f.listing_id AND s.rn2 = f.rn2 + 1))""",
    "history": "SELECT f.*, s.price_cents, s.delivered_cents, s.model, s.family FROM fold f JOIN seq s "
               "USING (watch, source, listing_id, rn2) WHERE f.event IN ('new', 'price_drop', 'price_up')",
    "state": """
      SELECT s.* EXCLUDE (status, missed, rn, rn2, complete, scan_no), f.merged AS seen_status, f.first_seen, f.notified, f.notified_at, f.notify_count,
        CASE WHEN f.merged IN ('active', 'pending') THEN least(t.total - s.thru, 2) ELSE 0 END AS missed_scans,
        CASE WHEN f.merged IN ('active', 'pending') AND t.total - s.thru >= 2 THEN 'gone' ELSE f.merged END AS status
      FROM (SELECT *, row_number() OVER (PARTITION BY watch, source, listing_id ORDER BY rn2 DESC) AS back,
              min(seen_at) OVER (PARTITION BY watch, source, listing_id) AS first_seen FROM fold) f
      JOIN seq s USING (watch, source, listing_id, rn2)
      JOIN (SELECT watch, source, max(thru) AS total FROM scans GROUP BY ALL) t USING (watch, source)
      WHERE back = 1""",
    "latest": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watch, source, listing_id ORDER BY seen_at DESC, obs_id DESC)
        AS last_no FROM history) WHERE last_no = 1""",
}

SCAM = ", ".join([
    "CASE WHEN unit_cents * 100 < mkt * below_pct THEN 'prix ' || " + EUR0.format("unit_cents") + " || ' € < ' || below_pct || "
    "'% de la médiane (' || " + EUR0.format("mkt") + " || ' €)' END",
    "CASE WHEN coalesce(seller_reviews, 0) = 0 AND unit_cents < mkt THEN 'vendeur sans évaluation et prix sous le marché' END",
    "CASE WHEN coalesce(shipping_cents, 0) > max_ship OR (price_cents > 0 AND coalesce(shipping_cents, 0) * 100 > price_cents * max_ship_pct) "
    "THEN 'frais de port aberrants (' || " + EUR0.format("coalesce(shipping_cents, 0)") + " || ' €)' END",
    "CASE WHEN delivery = FALSE AND secure_payment = FALSE AND coalesce(seller_reviews, 0) = 0 "
    "THEN 'ni livraison, ni paiement sécurisé, vendeur sans historique' END",
])
CAN_ALERT = ("(enabled AND keep AND {m} = 'active' AND NOT (suspicious <> '' AND sus_mode = 'never'){review})")

DEPS = {
    "obs": [], "cfg": [], "log": ["obs"], "merged": ["log"], "priced": ["merged"], "staged": ["priced", "cfg"],
    "decided": ["staged"], "scored": ["decided"], "scans": ["obs"], "seq": ["scored", "scans"], "fold": ["seq"],
    "history": ["fold", "seq"], "state": ["fold", "seq", "scans"], "latest": ["history"], "priced_log": ["log"],
    "decided_log": ["priced_log", "cfg"],
}
CTES["priced_log"] = CTES["priced"].format(src="log")
CTES["priced"] = CTES["priced"].format(src="merged")
CTES["decided_log"] = re.sub("FROM staged", "FROM (" + CTES["staged"].replace("priced", "priced_log") + ")", CTES["decided"])
SCORED_TEMPLATE = CTES["scored"]
CTES["scored"] = SCORED_TEMPLATE.format(scam=SCAM, market="CASE WHEN ref_cents > 0 THEN ref_cents END", from_="decided")
CTES["fold"] = CTES["fold"].format(can=CAN_ALERT.format(m="status", review=""), can2=CAN_ALERT.format(m="merged", review=""))
RECURSIVE = {"fold"}


def compose(final: str, *names: str, extra: dict[str, str] | None = None, swap: dict[str, str] | None = None) -> str:
    """``WITH`` the named expressions (and what they need), then ``final``. ``swap`` replaces bodies for this query alone."""
    body = CTES | (swap or {})
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPS[name]:
            visit(dep)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    # MATERIALIZED keeps the engine from expanding the shared expressions once per use.
    bodies = [f"{n} AS ({body[n]})" if n in RECURSIVE else f"{n} AS MATERIALIZED ({body[n]})" for n in done]
    bodies += [f"{n} AS ({x})" for n, x in (extra or {}).items()]
    return ("WITH RECURSIVE " + ",\n".join(bodies) + "\n" if bodies else "") + final

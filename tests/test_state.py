"""Status, events, gone scans and alerts over hand-written scans, against a step-by-step model."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pricelens.operators import alerts as al
from pricelens.operators import history as hi
from pricelens.operators.snapshots import advance_state

KEY = {"watch": "w", "source": "lbc"}
DDL = ("watch string, source string, listing_id string, scan_id date, seen_at timestamp, status string, unit_cents bigint, keep boolean, enabled boolean, "
       "suspicious array<string>, suspicious_mode string, price_drop_pct bigint, obs_id bigint, url string, title string, model string, family string, "
       "brand string, verdict string, flags array<string>, price_cents bigint, shipping_cents bigint, fees_cents bigint, delivered_cents bigint, quantity bigint, "
       "tier string, priority string, condition string, seller_name string, seller_rating bigint, seller_reviews bigint, location string, delivery boolean, posted_at string")
NAMES = [c.strip().split()[0] for c in DDL.split(", ")]


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def sighting(listing, scan, status="active", unit=10000, **more):
    base = dict.fromkeys(NAMES)
    base.update(KEY, listing_id=listing, scan_id=day(scan), seen_at=dt.datetime.combine(day(scan), dt.time()), status=status, unit_cents=unit, keep=True,
                enabled=True, suspicious=[], suspicious_mode="separate", price_drop_pct=5, obs_id=scan, quantity=1, flags=[])
    base.update(more)
    return tuple(base[n] for n in NAMES)


def frames(spark, rows, complete):
    scans = spark.createDataFrame([("w", "lbc", day(i), c) for i, c in enumerate(complete)], "watch string, source string, scan_id date, whole boolean")
    log = hi.scan_log(scans.select("watch", "source", "scan_id"), F.lit(True)).drop("complete", "complete_through")
    log = log.join(scans, ["watch", "source", "scan_id"])
    from pyspark.sql.window import Window

    w = Window.partitionBy("watch", "source").orderBy("scan_id")
    log = log.withColumnRenamed("whole", "complete").withColumn("complete_through", F.sum(F.col("complete").cast("int")).over(w))
    return spark.createDataFrame(rows, DDL), log


def model(seen, complete, gone_after=2):
    """Statuses of one listing by the plain rules: (merged per sighting, final status, missed)."""
    rank = {"active": 0, "gone": 1, "pending": 2, "sold": 3}
    state, missed, merged = None, 0, []
    for scan, whole in enumerate(complete):
        if scan in seen:
            now = seen[scan]
            if state is not None:
                worst = state if rank[state] >= rank[now] else now
                now = "active" if state == "gone" and now == "active" else worst
            state, missed = now, 0
            merged.append(now)
        elif whole and state in ("active", "pending"):
            missed += 1
            if missed >= gone_after:
                state = "gone"
    return merged, state, missed


def test_statuses_match_the_plain_rules(spark):
    rng = random.Random(7)
    complete = [rng.random() < 0.75 for _ in range(16)]
    histories = {str(i): {s: rng.choice(["active"] * 5 + ["pending", "pending", "sold", "gone"]) for s in range(16) if rng.random() < 0.45} for i in range(60)}
    histories = {k: v for k, v in histories.items() if v}
    rows = [sighting(k, s, st, 10000 - s) for k, v in histories.items() for s, st in v.items()]
    obs, scans = frames(spark, rows, complete)
    lines = hi.timeline(obs, scans)
    got = {}
    for r in lines.orderBy("listing_id", "scan_id").collect():
        got.setdefault(r.listing_id, []).append(r.merged_status)
    final = {r.listing_id: r for r in hi.snapshot(lines, scans).collect()}
    for k, seen in histories.items():
        merged, state, missed = model(seen, complete)
        assert got[k] == merged, (k, seen)
        assert final[k].status == state and final[k].missed_scans == missed, (k, seen, complete)

    # The same scans in two and in many steps give the same snapshot.
    whole = {r.listing_id: r for r in advance_state(None, obs, scans).collect()}
    for cuts in ([8], [3, 6, 9, 12]):
        state, low = None, 0
        for cut in [*cuts, 16]:
            known = scans.where(F.col("scan_id") < F.lit(day(cut)))
            batch = obs.where((F.col("scan_id") >= F.lit(day(low))) & (F.col("scan_id") < F.lit(day(cut))))
            state, low = advance_state(state, batch, known), cut
            state = spark.createDataFrame(state.collect(), state.schema)
        for r in state.collect():
            a, b = r.asDict(), whole[r.listing_id].asDict()
            assert {k: v for k, v in a.items() if k != "alerts"} == {k: v for k, v in b.items() if k != "alerts"}


def test_price_events_and_history(spark):
    rows = [sighting("a", 0), sighting("a", 1), sighting("a", 2, unit=9000), sighting("a", 3, unit=9500), sighting("a", 4, "sold", 9500)]
    obs, scans = frames(spark, rows, [True] * 5)
    lines = hi.timeline(obs, scans)
    assert [r.event for r in lines.orderBy("scan_id").collect()] == ["new", "unchanged", "price_drop", "price_up", "status_change"]
    assert hi.price_history(lines).count() == 3


def test_alert_baseline_is_the_last_notified_price(spark):
    rows = [sighting("a", 0), sighting("a", 1, unit=9700), sighting("a", 2, unit=9400), sighting("a", 3, unit=9300),
            sighting("late", 0, keep=False), sighting("late", 1),
            sighting("mute", 0, suspicious=["x"], suspicious_mode="never"), sighting("mute", 1),
            sighting("sold", 0, "sold"), sighting("edge", 0), sighting("edge", 1, unit=9500)]
    obs, scans = frames(spark, rows, [True] * 4)
    alerts = al.alert_rows(al.fold_alerts(hi.timeline(obs, scans))).orderBy("listing_id", "scan_id").collect()
    assert [(r.listing_id, r.event, r.unit_cents) for r in alerts] == [
        ("a", "new", 10000), ("a", "price_drop", 9400), ("edge", "new", 10000), ("edge", "price_drop", 9500), ("late", "new", 10000), ("mute", "new", 10000)]


def test_ignored_review_mutes(spark):
    from pricelens.operators.reviews import review_at_scan, review_overlay

    obs, scans = frames(spark, [sighting("a", 0, keep=False), sighting("a", 1), sighting("a", 2)], [True] * 3)
    ddl = "watch string, source string, listing_id string, ts timestamp, event_id bigint, review string, note string"
    events = spark.createDataFrame([("w", "lbc", "a", dt.datetime(2026, 1, 1, 12), 1, "ignored", "n" * 1200),
                                    ("w", "lbc", "a", dt.datetime(2026, 1, 2, 12), 2, "", None)], ddl)
    lines = review_at_scan(hi.timeline(obs, scans), events, F.date_add(F.to_date("ts"), 1))
    alerts = al.alert_rows(al.fold_alerts(lines)).collect()
    assert [(r.event, r.scan_id) for r in alerts] == [("new", day(2))]
    kept = review_overlay(events).collect()[0]
    assert kept.review == "" and len(kept.note) == 1000

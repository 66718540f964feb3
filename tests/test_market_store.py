"""The maintained market against a recount, names and labels of profiles, and listings read by watch."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricelens.functions.messages import attribute_lines
from pricelens.operators.market import attach_market, market_table, snapshot_points
from pricelens.operators.profiles import PROFILES, Profile, classify_by_watch, register, with_market_names
from pricelens.scan import _by_watch
from pricelens.session import shared_folder
from pricelens.streaming.market_store import MarketStore, running_medians

ROW = ("watch string, source string, listing_id string, keep boolean, quantity bigint, suspicious array<string>, "
       "last_point struct<seen_at: timestamp, obs_id: bigint, unit_cents: bigint, model: string, family: string>")
START = dt.datetime(2026, 1, 1, 12)


def hours(n):
    return START + dt.timedelta(hours=n)


def recount(state, as_of, days):
    prices = defaultdict(list)
    for (watch, _, _), (keep, quantity, suspicious, point) in state.items():
        if point and keep and quantity == 1 and suspicious == [] and point[2] and point[0] >= as_of - dt.timedelta(days=days):
            for level, name in (("model", point[3]), ("family", point[4])):
                if name:
                    prices[watch, level, name].append(point[2])
    return {k: (statistics.median(v), len(v)) for k, v in prices.items()}


def told(market):
    return {(r.watch, r.level, r.name): (r.median_cents, r.median_samples) for r in market.collect()}


def test_maintained_market_equals_a_recount(spark):
    draw = random.Random(7)
    store, state, days = MarketStore(shared_folder(spark, "market"), 2, 2), {}, 2
    for version, at in enumerate([0, 5, 5, 40, 53, 54, 200]):  # the third at the same time, the last with all expired but its own
        changed = {}
        for _ in range(0 if version == 4 else 25):
            key = draw.choice("ab"), draw.choice(["lbc", "ebay"]), str(draw.randrange(12))
            point = draw.choice([None, *[(hours(at - draw.randrange(60)), draw.randrange(9), draw.choice([0, 100, 100, 250, 999]), draw.choice([None, "", "m1", "m2"]),
                                          draw.choice(["f1", "f2", None]))] * 5])
            changed[key] = draw.choice([True, True, False, None]), draw.choice([1, 1, 1, 2, None]), draw.choice([[], [], ["x"], None]), point
        state |= changed
        rows = spark.createDataFrame([(*k, *v) for k, v in changed.items()], ROW)
        store.advance(rows, hours(at), version)
        if version in (2, 3):
            store.advance(rows, hours(at), version)  # run again
        want = recount(state, hours(at), days)
        assert told(store.market(spark, version)) == want
        every = spark.createDataFrame([(*k, *v) for k, v in state.items()], ROW)
        assert told(market_table(snapshot_points(every, F.lit(hours(at).isoformat(" ")).cast("timestamp"), days))) == want
    with pytest.raises(ValueError, match="cannot be read"):
        store.advance(rows, hours(0), 7)


def test_a_version_writes_what_changed(spark):
    store = MarketStore(shared_folder(spark, "market"), 30)
    hot = [("a", "lbc", str(i), True, 1, [], (START, i, 100 + i % 50, "m", "f")) for i in range(3000)]
    store.advance(spark.createDataFrame(hot, ROW), START, 0)
    assert told(store.market(spark, 0))["a", "model", "m"] == (124.5, 3000)
    one = [("a", "lbc", "7", True, 1, [], (hours(1), 9000, 90, "m", "f"))]
    store.advance(spark.createDataFrame(one, ROW), hours(1), 1)
    sizes = {t.root.rsplit("/", 1)[-1]: spark.read.parquet(t.path(0, 1)).count() for t in (store.points, store.due, store.counts, store.medians)}
    assert sizes == {"points": 1, "due": 1, "counts": 4, "medians": 2}
    assert told(store.market(spark, 1))["a", "family", "f"] == (124.5, 3000)
    store.advance(spark.createDataFrame([], ROW), hours(2), 2)
    assert told(store.market(spark, 2)) == told(store.market(spark, 1))


def test_running_medians_of_even_odd_and_emptied_names(spark):
    counts = [("w", "model", "even", 10, 1), ("w", "model", "even", 20, 1), ("w", "model", "odd", 5, 1), ("w", "model", "odd", 7, 3), ("w", "model", "odd", 9, 1),
              ("w", "model", "half", 1, 2), ("w", "model", "half", 4, 2), ("w", "model", "gone", 8, 0), ("w", "model", "less", 1, 0), ("w", "model", "less", 3, 1)]
    found = running_medians(spark.createDataFrame(counts, "watch string, level string, name string, unit_cents bigint, n bigint"))
    assert {r.name: (r.median_cents, r.median_samples) for r in found.collect()} == {
        "even": (15.0, 2), "odd": (7.0, 5), "half": (2.5, 4), "gone": (None, 0), "less": (3.0, 1)}


def test_profiles_name_rows_in_the_market(spark):
    register(Profile("by_brand", PROFILES["keywords"].classify, market_key=lambda: (F.col("brand"), F.lit(None).cast("string"))))
    try:
        rows = spark.createDataFrame([("w", "m", "f", "b", 100), ("v", "m", "f", "b", 300), ("w", None, "f", None, 500)],
                                     "watch string, model string, family string, brand string, unit_cents bigint")
        plain = {"w": {"profile": {"type": "keywords"}}, "v": {"profile": {"type": "keywords"}}}
        assert with_market_names(rows, plain).columns == rows.columns
        named = with_market_names(rows, plain | {"w": {"profile": {"type": "by_brand"}}})
        assert told(market_table(named)) == {("w", "model", "b"): (100, 1), ("v", "model", "m"): (300, 1), ("v", "family", "f"): (300, 1)}
        judged = {(r.watch, r.unit_cents): (r.median_cents, r.median_samples) for r in attach_market(named, market_table(named)).collect()}
        assert judged == {("w", 100): (100.0, 1), ("v", 300): (300.0, 1), ("w", 500): (None, 0)}
    finally:
        del PROFILES["by_brand"]


def test_attribute_lines_follow_the_labels(spark):
    rows = spark.createDataFrame([({"b": "2", "a": "", "c": "x"}, [("c", "C"), ("a", "A"), ("b", "B (u)"), ("z", "Z")]), (None, [("a", "A")]), ({"a": "1"}, None), ({"a": None}, [("a", "A")])],
                                 "attrs map<string,string>, labels array<struct<name: string, label: string>>")
    assert [r[0] for r in rows.select(attribute_lines(F.col("attrs"), F.col("labels"))).collect()] == [["C : x", "B (u) : 2"], [], [], []]


def test_each_profile_reads_the_folders_of_its_watches(spark):
    rows = spark.createDataFrame([(w, f"3080 {w}", "", None) for w in ("1", "2", "3", None)] * 3, "watch string, title string, description string, condition_code string")
    stored = _by_watch(rows)
    assert dict(stored.dtypes)["watch"] == "string"
    assert sorted((r.watch or "", r.title or "") for r in stored.collect()) == sorted((r.watch or "", r.title or "") for r in rows.collect())
    watches = {w: {"profile": {"type": "keywords", "keywords": {"reject": [w]}}} for w in ("1", "2", "3")}
    judged = classify_by_watch(stored, watches)
    drives = {w: {"profile": {"type": "hdd", "hdd": {"target_capacity_tb": int(w)}}} for w in ("1", "2", "3")}
    for frame, scans in ((judged, 1), (classify_by_watch(stored, drives), 3)):  # keyword watches are one pass, drive settings one each
        plan = frame._jdf.queryExecution().executedPlan().toString()
        pruned = [line for line in plan.splitlines() if "FileScan" in line]
        assert len(pruned) == scans and all("PartitionFilters: [" in line and "watch#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in pruned)
    assert {(r.watch, r.verdict, r.reason) for r in judged.collect()} == {(w, "reject", f"reject:{w}") for w in ("1", "2", "3")}
    assert judged.count() == 9

"""Scan log, keyed state and the stream of sightings and pages, against one batch and against plain rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricelens.operators.scans import scan_facts, scan_log_of
from pricelens.plans import frames as fr
from pricelens.session import shared_folder
from pricelens.sources.observations import observation_log, table
from pricelens.streaming.keyed_state import KeyedState
from pricelens.streaming.scan_stream import ScanStream, joined_stream

SF = "/root/testdata/sf0.001"
PAGES = "watch string, source string, scan_id date, page_no bigint, max_pages bigint, http_status bigint, parsed boolean, items bigint"


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def page(scan, source="lbc", no=1, last=1, status=200, items=0, parsed=True):
    return "LARGE", source, day(scan), no, last, status, parsed, items


def test_scan_log_knows_empty_and_broken_scans_in_any_number_of_parts(spark):
    pages = [page(0, items=3), page(1), page(2, status=429), page(3, source="vinted"), page(4, source="vinted", items=5), page(5, no=1, last=2), page(6, no=1, last=2),
             page(6, no=2, last=2, parsed=False), page(7, no=3, last=2, status=500), page(8, source="hfr")]
    sightings = spark.createDataFrame([("LARGE", "lbc", day(9))], "watch string, source string, scan_id date")
    facts = scan_facts(spark.createDataFrame(pages, PAGES), sightings)
    log = {(r.source, r.scan_id): (r.complete, r.closed, r.scan_no, r.complete_through) for r in scan_log_of(facts).collect()}
    assert log == {("lbc", day(0)): (True, True, 1, 1), ("lbc", day(1)): (True, True, 2, 2), ("lbc", day(2)): (False, True, 3, 2), ("lbc", day(5)): (True, True, 4, 3),
                   ("lbc", day(6)): (False, True, 5, 3), ("lbc", day(7)): (True, True, 6, 4), ("lbc", day(9)): (False, False, 7, 4),
                   ("vinted", day(3)): (False, True, 1, 0), ("vinted", day(4)): (True, True, 2, 1), ("hfr", day(8)): (False, True, 1, 0)}
    parts = [scan_facts(spark.createDataFrame(pages[i::3], PAGES)) for i in range(3)] + [scan_facts(spark.createDataFrame([], PAGES), sightings)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert {(r.source, r.scan_id): (r.complete, r.closed, r.scan_no, r.complete_through) for r in scan_log_of(whole).collect()} == log


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_parts_cover_every_version_once(fan):
    state = KeyedState("x", ["k"], fan)
    for version in range(200):
        covered = []
        for tier, v in state.parts(version):
            covered += range(v + 1 - fan**tier, v + 1)
        assert covered == list(range(version + 1))
        assert len(state.parts(version)) <= (fan - 1) * 9


def test_keyed_state_holds_the_newest_row_and_writes_what_changed(spark):
    draw = random.Random(4)
    state, wanted = KeyedState(shared_folder(spark, "keyed"), ["k"], 2, 8), {}
    for version in range(9):
        changed = {draw.randrange(40): version for _ in range(6)} if version != 5 else {}
        state.write(spark.createDataFrame([(k, v, [v]) for k, v in changed.items()], "k long, value long, more array<long>"), version)
        state.write(spark.createDataFrame([(k, v, [v]) for k, v in changed.items()], "k long, value long, more array<long>"), version)  # run again
        wanted |= changed
        assert spark.read.parquet(state.path(0, version)).count() == len(changed)
        if version in (3, 8):
            assert {r.k: r.value for r in state.read(spark, version).collect()} == wanted
            some = spark.createDataFrame([(1,), (1,), (7,), (99,)], "k long")
            assert {r.k: r.value for r in state.read(spark, version, some).collect()} == {k: v for k, v in wanted.items() if k in (1, 7)}
    assert {r.k for r in state.read(spark, 7).collect()} <= set(wanted)


def state_rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(
        "watch", "source", "listing_id", "obs_id", "unit_cents", "status", "seen_status", "first_seen", "last_seen", "missed_scans", "notified_cents", "notify_count", "last_point").collect())


def test_scans_split_over_batches_give_the_state_of_one_batch(spark):
    lines = table(spark, SF, "lineitem").where("l_suppkey % 4 < 2")
    log = lambda batch: observation_log(batch.sparkSession, SF, batch)
    seen = log(lines).select("watch", "source", "scan_id").distinct()
    pages = seen.select("watch", "source", "scan_id", *[F.lit(1).cast("bigint").alias(c) for c in ("page_no", "max_pages")], F.lit(200).cast("bigint").alias("http_status"),
                        F.lit(True).alias("parsed"), F.lit(1).cast("bigint").alias("items"))
    extra = [("LARGE", "lbc", dt.date(2002, 1, 1), 1, 1, 200, True, 0), ("LARGE", "lbc", dt.date(2002, 2, 1), 1, 1, 200, True, 0), ("SMALL", "ebay", dt.date(2002, 1, 1), 1, 1, 200, True, 0)]
    pages = pages.unionByName(spark.createDataFrame(extra, PAGES))
    watches = fr.watches(spark)
    every = log(lines).select("watch", "source", "listing_id").distinct()
    ignored = every.where("watch = 'STANDARD'").withColumns({"ts": F.lit("1990-01-01").cast("timestamp"), "event_id": F.lit(1), "review": F.lit("ignored"), "note": F.lit(None).cast("string")})

    def job():
        return ScanStream(shared_folder(spark, "split"), watches, log, lambda b: b.select("watch", "source", "scan_id", "page_no", "max_pages", "http_status", "parsed", "items"),
                          ignored, F.to_date("ts"), fan=2)

    one, many = job(), job()
    one.process(joined_stream(lines, pages), 0)
    # a month's rows come in two batches, out of order by up to a month, its pages with the last of them
    month = F.months_between(F.trunc("l_shipdate", "month"), F.lit("1995-01-01").cast("date")) + (F.col("l_orderkey") % 2)
    read = F.months_between("scan_id", F.lit("1995-01-01").cast("date")) + 1
    for n in range(3):
        some = lines.where((month >= 28 * n) & (month < 28 * (n + 1)) if n < 2 else month >= 56)
        many.process(joined_stream(some, pages.where((read >= 28 * n) & (read < 28 * (n + 1)) if n < 2 else read >= 56)), n)
    assert state_rows(one.current_state(spark, 0)) == state_rows(many.current_state(spark, 2))
    alerts = lambda df: sorted(tuple(map(str, r)) for r in df.select("watch", "source", "listing_id", "scan_id", "event", "unit_cents", "prev_cents").collect())
    told = alerts(one.alerts(spark, 0))
    assert told == alerts(many.alerts(spark, 2)) and told and not [a for a in told if a[0] == "STANDARD"]
    released = [a for n in range(3) for a in alerts(many.released(spark, n))]
    assert len({a[:4] for a in released}) == len(released) >= len(told)
    touched = log(lines.where((month >= 56))).select("watch", "source", "listing_id").distinct().count()
    assert spark.read.parquet(many.state.path(0, 2)).count() == touched < one.current_state(spark, 0).count()
    assert spark.read.parquet(many.path("late")).count() == 0
    gone = {r.listing_id for r in many.current_state(spark, 2).where("watch = 'LARGE' AND source = 'lbc' AND status = 'gone'").collect()}
    assert gone == {r.listing_id for r in many.current_state(spark, 2).where("watch = 'LARGE' AND source = 'lbc' AND status NOT IN ('sold')").collect()}


def test_a_batch_leaves_nothing_cached(spark):
    """A standing stream runs many batches: what one keeps for itself is given back, and its alerts are those of a whole snapshot."""
    lines = table(spark, SF, "lineitem").where("l_partkey < 20")
    log = lambda batch: observation_log(batch.sparkSession, SF, batch)
    job = ScanStream(shared_folder(spark, "cached"), fr.watches(spark), log, lambda b: b.select("watch", "source", "scan_id", "page_no", "max_pages", "http_status", "parsed", "items"))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for n, some in enumerate((lines.where("year(l_shipdate) < 1998"), lines.where("year(l_shipdate) >= 1998"))):
        job.process(joined_stream(some, spark.createDataFrame([], PAGES)), n)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert spark.read.parquet(job.path("alerts")).where("event IS NOT NULL").count() > 0

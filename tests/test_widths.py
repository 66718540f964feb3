"""What is merged, sorted and stored: only the columns that a query asks for, and shared shuffles made once."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re

from pyspark.sql import functions as F

from pricelens.operators import history as hi
from pricelens.operators.merging import merge_scan
from pricelens.operators.scoring import score, with_prices
from pricelens.plans import frames as fr
from pricelens.plans.catalogue import load
from pricelens.sources.observations import observation_log


def tables(spark, folder):
    """Three parts sold by two suppliers: repeated line items, several sightings of a listing in a month, a missing date."""
    day = lambda n: dt.datetime(2001, 1 + n % 9, 1 + n % 27)
    line = [(n, n % 3, n % 2, 1 + n % 7, 1.0 + n % 20, 1800.0 * (1 + n % 20) + n * 7, 0.01 * (n % 9), 0.01 * (n % 8), "NAR"[n % 3 if n % 5 == 0 else 0], "OF"[n % 2], day(n)) for n in range(200)]
    line += line[:20] + [(900, 1, 1, 1, 5.0, 900.0, 0.0, 0.0, "N", "O", None)]
    spark.createDataFrame(line, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, l_discount double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(0, "red widget", "Brand#1", "SMALL", 1), (1, "blue bolt", "Brand#2", "LARGE", 7), (2, "ring", "Brand#3", "STANDARD", 3)],
                          "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(0, "S0", 1, 500.0), (1, "S1", 2, 2500.0)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_judged_then_merged_is_merged_then_judged(spark, tmp_path):
    sf = tables(spark, tmp_path)
    columns = [*fr.SHOWN, *fr.MARKET, "priority"]
    lean = fr.scored_scan_rows(spark, sf, columns)
    assert "notes" not in lean.columns and "tiers" not in lean.columns
    full = score(merge_scan(fr.log(spark, sf)), fr.watches(spark))
    assert rows_of(lean.select(*sorted(lean.columns))) == rows_of(full.select(*sorted(lean.columns)))


def test_lean_rows_carry_no_settings(spark, tmp_path):
    rows = hi.lean(score(merge_scan(with_prices(observation_log(spark, tables(spark, tmp_path)))), fr.watches(spark)))
    assert not {"tiers", "tier_row", "flag_notes", "attr_labels", "watch_title", "condition_id"} & set(rows.columns)
    assert {"notes", "tags", "enabled", "suspicious_mode", "price_drop_pct", "url"} <= set(rows.columns)


def test_settings_of_watches_join_the_timeline_and_are_not_shuffled(spark, tmp_path):
    sf = tables(spark, tmp_path)
    lines = fr.lines(spark, sf, (*fr.SHOWN, "model"))
    merged = lines._jdf.queryExecution().optimizedPlan().toJSON()
    aggregates = merged[merged.index("plans.logical.Aggregate"):]
    assert "model" in aggregates and not any(f'"name":"{c}"' in aggregates for c in fr.SETTINGS)
    whole = fr.lines(spark, sf).select(*lines.columns)
    assert set(fr.SETTINGS) <= set(lines.columns) and rows_of(lines) == rows_of(whole)


def test_snapshot_completed_by_last_facts(spark, tmp_path):
    sf = tables(spark, tmp_path)
    state = fr.state(spark, sf, False, ("model", "family"))
    whole = hi.with_last_facts(state, fr.facts_of(spark, sf, state.select(*hi.KEY, F.col("last_scan_id").alias("scan_id"))))
    plain = fr.state(spark, sf, False)
    assert set(whole.columns) == set(plain.columns) and rows_of(whole.select(*plain.columns)) == rows_of(plain)


def test_market_from_history_merges_once(spark, tmp_path):
    """Both reads of the timeline share the shuffle of the merge; a generator in the watches would part them."""
    assert "Generate" not in fr.watches(spark)._jdf.queryExecution().optimizedPlan().toString()
    sf = tables(spark, tmp_path)
    market = load()[0]["market_median_history"](spark, sf)
    market.collect()
    assert "ReusedExchange" in market._jdf.queryExecution().executedPlan().toString()
    assert rows_of(market) == rows_of(load()[0]["market_median"](spark, sf))


def test_sightings_are_shuffled_twice(spark, tmp_path):
    """For the merge and by listing: neither the scan log nor the reviews move them again."""
    sf = tables(spark, tmp_path)
    spark.createDataFrame([(n, n % 3, "FOP"[n % 3], dt.datetime(2001, 1 + n % 9, 1), "5-LOW" if n % 2 else "1-URGENT") for n in range(40)],
                          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    alerts = load()[0]["alert_stream"](spark, sf)
    planned = alerts._jdf.queryExecution().executedPlan().toString()
    above = planned[:planned.index("Union")]
    assert "Exchange hashpartitioning" not in above and "SortMergeJoin" not in planned[:planned.index("SortAggregate")]


def test_alerts_are_decided_once_for_their_texts(spark, tmp_path):
    sf = tables(spark, tmp_path)
    spark.createDataFrame([], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    told = load()[0]["alert_message"](spark, sf)
    assert "Window" not in told._jdf.queryExecution().optimizedPlan().toString()
    keys = ["watch", "source", "listing_id", "scan"]
    assert told.count() > 0 and rows_of(told.select(*keys, "event")) == rows_of(load()[0]["alert_stream"](spark, sf).select(*keys, "event"))


#: Facts of a sighting that no state, missing listing or price point tells.
UNREAD = {"url", "title", "seller_name", "location", "condition", "notes", "tags", "posted_at"}


def merged_facts(df):
    """Facts of the sightings that the merges of a plan move."""
    merges = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "min_by(" in line]
    assert merges
    return set(re.findall(r"(\w+)#\d+", " ".join(merges)))


def test_state_is_advanced_by_narrow_rows(spark, tmp_path):
    from pricelens.operators.snapshots import advance_state

    sf = tables(spark, tmp_path)
    narrow, scans = fr.scored_scan_rows(spark, sf, ("tier", "keep", "suspicious")), fr.scans(spark, sf)
    settings, cut = fr.watches(spark), F.lit("2001-05-01").cast("date")

    def advanced(rows, **more):
        before = advance_state(None, rows.where(F.col("scan_id") < cut), scans.where(F.col("scan_id") < cut), **more)
        return advance_state(before, rows.where(F.col("scan_id") >= cut), scans, **more)

    lean, whole = advanced(narrow, settings=settings), advanced(fr.scored_scan_rows(spark, sf))
    shown = [*[c for c in lean.columns if c != "last_point"], "last_point.obs_id"]
    assert rows_of(lean.select(*shown)) == rows_of(whole.select(*shown))
    assert not UNREAD & merged_facts(load()[0]["state_merge"](spark, sf))


def test_missing_listings_and_details_move_what_they_tell(spark, tmp_path):
    sf = tables(spark, tmp_path)
    assert not {*UNREAD, "suspicious", "tier"} & merged_facts(load()[0]["missing_listings"](spark, sf))
    assert not UNREAD & merged_facts(load()[0]["enrich_details"](spark, sf))


def test_stream_keeps_the_facts_that_its_readers_name(spark, tmp_path):
    from pricelens.plans import scan_queries, stream_queries
    from pricelens.sources.observations import table

    sf = tables(spark, tmp_path / "in")
    lines, narrow = table(spark, sf, "lineitem"), stream_queries.job_for(spark, sf, str(tmp_path / "narrow"))
    whole = dataclasses.replace(narrow, root=str(tmp_path / "whole"), columns=None)
    for job in (narrow, whole):
        job.process(lines, 0)
    lean, full = (spark.read.parquet(j.path("state", 0)) for j in (narrow, whole))
    assert not UNREAD & set(lean.columns) and UNREAD <= set(full.columns)
    for t, columns in (("state", lean.columns), ("history", spark.read.parquet(narrow.path("history", 0)).columns), ("alerts", ["listing_id", "event", "unit_cents"])):
        assert rows_of(spark.read.parquet(narrow.path(t, 0)).select(*columns)) == rows_of(spark.read.parquet(whole.path(t, 0)).select(*columns))
    daily = scan_queries.job_for(spark, sf, str(tmp_path / "daily"))
    pages = scan_queries._page(scan_queries.daily(observation_log(spark, sf)).select("watch", "source", "scan_id").distinct(), F.lit(200), 1)
    daily.process(scan_queries.joined_stream(lines, pages), 0)
    assert not UNREAD & set(daily.state.read(spark, 0).select(F.inline("open")).columns)

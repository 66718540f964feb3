"""Detail budget, second judgement, page facts and whole scans from raw pages."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pricelens.operators.scans import scan_facts
from pricelens.operators.second_pass import mark_new, second_pass, within_budget
from pricelens.scan import CONTRACT, as_listings, page_facts, scan
from pricelens.config import watch_frame
from pricelens.operators.profiles import PROFILES
from pricelens.plans.whole_scan_queries import WATCHES
from pricelens.session import shared_folder

ROW = "watch string, source string, listing_id string, scan_id date, seen_at timestamp, obs_id bigint, keep boolean, description string, status string, shipping_cents bigint"
DETAIL = "watch string, source string, listing_id string, description string, status string, shipping_cents bigint"


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def row(listing, scan_no, obs, keep=True, source="lbc", description="old", shipping=None):
    return "LARGE", source, listing, day(scan_no), dt.datetime.combine(day(scan_no), dt.time()), obs, keep, description, "active", shipping


def test_budget_is_spent_on_details_that_exist_in_order_of_arrival(spark):
    rows = spark.createDataFrame([row("a", 0, 5), row("b", 0, 1), row("c", 0, 2, keep=False), row("d", 0, 3), row("e", 0, 4), row("d", 1, 6), row("f", 1, 7), row("g", 0, 1, source="hfr")], ROW)
    details = spark.createDataFrame([("LARGE", s, k, "new", "active", 1) for s, k in [("lbc", x) for x in "acdef"] + [("hfr", "g")]], DETAIL)
    read = lambda budgets, previous=None: sorted((r.listing_id, r.scan_id) for r in within_budget(mark_new(rows, previous), details, budgets).collect())
    assert read({"lbc": 2}) == [("d", day(0)), ("e", day(0)), ("f", day(1))]  # b has no detail and costs nothing, c is not kept, d is new once
    assert read({"lbc": 1, "hfr": 1}) == [("d", day(0)), ("f", day(1)), ("g", day(0))]
    assert read({"lbc": 9}, rows.where("listing_id IN ('d', 'f')")) == [("a", day(0)), ("e", day(0))]
    assert read({}) == [] and read({"lbc": 0}) == []


def test_only_enriched_rows_are_judged_again(spark):
    rows = mark_new(spark.createDataFrame([row("a", 0, 1), row("b", 0, 2, shipping=5), row("c", 0, 3), row("d", 0, 4, keep=False)], ROW)).withColumn("judged", F.lit(1))
    details = spark.createDataFrame([("LARGE", "lbc", "a", "broken", "sold", 9), ("LARGE", "lbc", "b", None, "pending", 9), ("LARGE", "lbc", "d", "broken", "sold", 9)], DETAIL)

    def judge(df):
        return df.withColumn("keep", ~F.col("description").contains("broken")).withColumn("judged", F.col("judged") + 1)

    found = {r.listing_id: r for r in second_pass(rows, details, {"lbc": 5}, judge).collect()}
    assert {k: (r.enriched, r.judged, r.keep, r.description, r.status, r.shipping_cents) for k, r in found.items()} == {
        "a": (True, 2, False, "broken", "sold", 9), "b": (True, 2, True, "old", "pending", 5), "c": (False, 1, True, "old", "active", None), "d": (False, 1, False, "old", "active", None)}
    assert second_pass(rows.limit(0), details, {"lbc": 5}, judge).count() == 0


def ad_page(ads, pages=1):
    data = {"props": {"pageProps": {"searchData": {"max_pages": pages, "ads": ads}}}}
    return f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'


def ad(number, price, title="blue widget", **more):
    return {"list_id": number, "subject": title, "body": "", "price_cents": price, "status": "active", "attributes": [], "first_publication_date": "", **more}


PAGES = "watch string, source string, scan_id date, page_id bigint, fetched_at timestamp, url string, body string"


def page(number, scan_no, body, watch="LARGE", source="lbc"):
    return watch, source, day(scan_no), number, dt.datetime.combine(day(scan_no), dt.time()), None, body


def test_page_facts_tell_broken_pages(spark):
    pages = spark.createDataFrame([page(1, 0, ad_page([ad(1, 5)], 3)), page(2, 1, "<html>challenge</html>"), page(3, 2, ad_page([])), page(4, 0, "", source="ebay"), page(5, 0, "{}", source="vinted"),
                                   page(6, 3, None)], PAGES)
    facts = {(r.source, r.scan_id): (r.max_pages, r.parsed, r.items) for r in page_facts(pages).collect()}
    assert facts == {("lbc", day(0)): (3, True, 1), ("lbc", day(1)): (None, False, None), ("lbc", day(2)): (1, True, 0), ("lbc", day(3)): (None, False, None),
                     ("ebay", day(0)): (None, False, None), ("vinted", day(0)): (None, True, None)}


def test_listings_of_the_contract(spark):
    rows = spark.createDataFrame([("LARGE", "lbc", day(0), 7, "x", 100, None)], "watch string, source string, scan_id date, page_id bigint, listing_id string, price_cents bigint, other int")
    found = as_listings(rows)
    assert found.columns == [*CONTRACT, "delivered_cents"] and found.first().obs_id == 7 and found.first().delivered_cents == 100 and found.first().shipping_estimated is False


@pytest.fixture(scope="module")
def scanned(spark):
    """Four scans of one search: a listing drops in price, one vanishes through whole empty scans, one is rejected by its detail."""
    first = [ad(1, 100000), ad(2, 100000, "red bolt"), ad(3, 100000, "cold ring"), ad(4, 100000, "hot gizmo")]
    pages = [page(1, 0, ad_page(first)), page(2, 1, ad_page([ad(1, 80000)])), page(3, 2, ad_page([])), page(4, 3, ad_page([]))]
    details = spark.createDataFrame([("LARGE", "lbc", "3", "a gizmo really", "active", None)], DETAIL)
    rules = watch_frame(spark, WATCHES, PROFILES)
    return spark.createDataFrame(pages, PAGES), rules, details


def told(frame):
    return sorted((r.listing_id, str(r.scan_id), r.event, r.unit_cents) for r in frame.collect())


def test_a_scan_ends_in_alerts_and_state(spark, scanned):
    pages, rules, details = scanned
    found = scan(pages, WATCHES, rules, details, {"lbc": 1})
    state = {r.listing_id: r for r in found.state.collect()}
    assert {k: (r.keep, r.enriched) for k, r in state.items()} == {"1": (True, False), "2": (True, False), "3": (False, True), "4": (False, False)}
    assert all(r.status == "gone" for r in state.values()) and found.scans.count() == 4
    assert told(found.alerts) == [("1", "2026-01-01", "new", 100000), ("1", "2026-01-02", "price_drop", 80000), ("2", "2026-01-01", "new", 100000)]
    root = shared_folder(spark, "whole")
    found.store(root)
    assert told(spark.read.parquet(f"{root}/alerts")) == told(found.alerts)
    assert spark.read.parquet(f"{root}/history").count() == 5 and spark.read.parquet(f"{root}/state").count() == 4


def test_a_scan_goes_on_from_a_stored_state(spark, scanned):
    from pricelens.operators.scans import scan_facts

    pages, rules, details = scanned
    early, late = pages.where(F.col("scan_id") < day(1)), pages.where(F.col("scan_id") >= day(1))
    before = scan(early, WATCHES, rules, details, {"lbc": 1})
    root = shared_folder(spark, "before")
    before.store(root)
    after = scan(late, WATCHES, rules, details, {"lbc": 1}, previous=spark.read.parquet(f"{root}/state"), earlier_facts=scan_facts(page_facts(early)))
    assert told(after.alerts) == [("1", "2026-01-02", "price_drop", 80000)]
    assert {(r.listing_id, r.status, r.keep) for r in after.state.collect()} == {("1", "gone", True), ("2", "gone", True), ("3", "gone", False), ("4", "gone", False)}


def test_pages_are_parsed_once_and_only_topics_that_are_left(spark):
    from pricelens.plans.ingest_queries import captured
    from pricelens.sources.forum import forum_listings

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pages = captured(spark.createDataFrame([("LARGE", "lbc", day(0), 1, dt.datetime.combine(day(0), dt.time()), "u", ad_page([ad(1, 100)]))], PAGES))
    assert plan(scan_facts(page_facts(pages))).count("from_json(") == 1
    posts = plan(forum_listings(pages.drop("source"), ["blue"]))
    assert posts.index("MapInArrow") < posts.index("Join")  # the parent stands first


def test_captured_pages_can_be_read_by_several_tasks(spark):
    from pricelens.plans.ingest_queries import PAGES_A_FILE, captured

    n = 2 * PAGES_A_FILE + 1
    pages = captured(spark.range(n, numPartitions=1).select("id", F.lit("<html></html>").alias("body")))
    assert len(pages.inputFiles()) == 3 and pages.count() == n


def test_a_scan_of_unknown_watch_is_not_told_broken(spark):
    ddl = "watch string, source string, scan_id date, page_no bigint, max_pages bigint, http_status bigint, parsed boolean, items bigint"
    rows = [(None, "lbc", day(0), 1, 1, 200, False, 0), ("W", "lbc", day(0), 1, 2, 200, True, 1), ("W", "lbc", day(0), 3, 2, 500, False, 0),
            ("W", "lbc", day(1), 1, 1, 500, True, 1), ("W", "lbc", day(2), 4, 2, 500, True, 1)]
    assert {(r.watch, r.scan_id): (r.complete, r.ended) for r in scan_facts(spark.createDataFrame(rows, ddl)).collect()} == {
        (None, day(0)): (True, True), ("W", day(0)): (True, True), ("W", day(1)): (False, True), ("W", day(2)): (True, True)}

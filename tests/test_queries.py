"""Registered queries against their SQL on the smallest data, and the streamed run in several micro-batches."""

import duckdb
import pyarrow.parquet as pq
import pytest
from conftest import SF

import __spark_entry__ as entry_module
from check import TABLES, _text

FAST = ["unit_price", "tier_assign", "status_timeline", "price_events", "state_merge", "market_median", "rolling_market", "alert_stream", "daily_digest",
        "watch_stats", "source_health", "source_cooldown", "scan_completeness", "review_overlay", "classify_drives", "classify_pc", "classify_keywords", "classify_drives_titles", "classify_pc_titles", "classify_keyword_watches", "union_watches",
        "ingest_lbc_listings", "ingest_card_pages", "topic_price_extract", "stream_state_merge"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(tuple, pdf[cols].astype(object).where(pdf[cols].notna(), None).map(_text).values.tolist()))


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    got = rows_of(entry_module.queries()[name](spark, SF).toPandas())
    want = rows_of(con.sql(entry_module.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_stream_in_three_batches_equals_one(spark, tmp_path):
    from pricelens.plans.listing_queries import state_columns
    from pricelens.plans.stream_queries import job_for, line_stream
    from pricelens.sources.observations import table
    from pricelens.streaming.state_stream import last_version, run_available

    source = tmp_path / "lines"
    source.mkdir()
    data = pq.read_table(f"{SF}/lineitem.parquet").to_pandas()
    month = data["l_shipdate"].dt.to_period("M").astype(str)
    for i, (low, high) in enumerate([("0000", "1997-06"), ("1997-06", "1999-10"), ("1999-10", "9999")]):
        part = data[(month >= low) & (month < high)]
        part.astype({"l_shipdate": "datetime64[us]"}).to_parquet(source / f"part-{i}.parquet")
        import os

        os.utime(source / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    job = job_for(spark, SF, str(tmp_path / "out"))
    stream = line_stream(spark, str(source), table(spark, SF, "lineitem").schema, per_batch=1)
    done = run_available(stream, job, str(tmp_path / "ckpt"))
    assert done.lastProgress["batchId"] == 2
    streamed = rows_of(state_columns(last_version(spark, job, done)).toPandas())
    batch = rows_of(entry_module.queries()["state_merge"](spark, SF).toPandas())
    assert streamed == batch

"""Classified ads: result and detail pages that carry their data in one JSON island."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.listing import condition_from_label, weight_shipping_cents
from pricelens.functions.literals import once

SITE = "https://www.leboncoin.fr"
AD_DDL = (
    "list_id BIGINT, subject STRING, body STRING, url STRING, price ARRAY<DOUBLE>, price_cents BIGINT, status STRING, "
    "category_id STRING, category_name STRING, first_publication_date STRING, "
    "attributes ARRAY<STRUCT<key: STRING, value: STRING, value_label: STRING>>, owner STRUCT<name: STRING, type: STRING>, "
    "location STRUCT<city: STRING, city_label: STRING, country_id: STRING>, buyer_fee STRUCT<amount: BIGINT>"
)
PAGE_DDL = (f"_corrupt_record STRING, props STRUCT<pageProps: STRUCT<searchData: STRUCT<max_pages: INT, ads: ARRAY<STRUCT<{AD_DDL}>>>, "
            f"ad: STRUCT<{AD_DDL}>>>")


def _island(body: Column) -> Column:
    text = F.regexp_extract(F.coalesce(body, F.lit("")), fv.JSON_ISLAND, 1)
    return F.from_json(text, PAGE_DDL, {"columnNameOfCorruptRecord": "_corrupt_record"})


def _parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``island`` and its parsed ``data``, each made once however often they are asked for."""
    island = F.regexp_extract(F.coalesce("body", F.lit("")), fv.JSON_ISLAND, 1)
    read = pages.select("*", once(island).alias("island"))
    return read.select("*", once(F.from_json("island", PAGE_DDL, {"columnNameOfCorruptRecord": "_corrupt_record"})).alias("data"))


def _is_good() -> Column:
    return (F.col("island") != "") & F.col("data._corrupt_record").isNull()


def island_facts(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` but the body, ``parsed`` (is there a readable island), ``max_pages`` and number of ``ads`` of readable ones; one parse a page."""
    found, good = F.col("data.props.pageProps.searchData"), F.coalesce(_is_good(), F.lit(False))
    return _parsed(pages).select(*[c for c in pages.columns if c != "body"], good.alias("parsed"), F.when(good, F.coalesce(found["max_pages"], F.lit(1))).alias("max_pages"),
                                 F.when(good, F.size(F.coalesce(found["ads"], F.array()))).alias("ads"))


def read_islands(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their parsed island ``data``, pages without a readable island as error rows)."""
    read, good = _parsed(pages), _is_good()
    keys = [c for c in pages.columns if c != "body"]
    errors = read.where(~good).select(*keys, F.when(F.col("island") == "", "no embedded data").otherwise("unreadable data").alias("error"))
    return read.where(good).select(*keys, F.col("data.props.pageProps").alias("page")), errors


def search_pages(pages: DataFrame) -> DataFrame:
    """One row per ad in page order, with the number of result pages reported.

    Each page is parsed once: the outer explode keeps the optimizer from repeating the parse in a filter, and
    unreadable pages fall out as pages without ads (``read_islands`` reports them).
    """
    keys = [c for c in pages.columns if c != "body"]
    data = pages.select(*keys, _island(F.col("body"))["props"]["pageProps"]["searchData"].alias("found"))
    ads = data.select(*keys, F.coalesce("found.max_pages", F.lit(1)).alias("max_pages"), F.posexplode_outer("found.ads").alias("ad_no", "ad"))
    return ads.where(F.col("ad").isNotNull())


def _attr(key: str, label: bool = False) -> Column:
    """Value (or label) of an attribute; the last entry of a repeated key counts, absent is empty."""
    entry = F.try_element_at(F.filter("ad.attributes", lambda a: a["key"] == key), F.lit(-1))
    value = F.coalesce(entry["value"], F.lit(""))
    return F.coalesce(F.when(entry["value_label"] != "", entry["value_label"]), value) if label else value


def _digits(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def transaction_status(label: Column, fallback: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("vendu"), "sold").when(low.contains("cours"), "pending").otherwise(fallback)


def ad_listings(ads: DataFrame, weight_steps: list[tuple[int, int]], default_cents: int = 690) -> DataFrame:
    """Ads to listing columns. An ad with an unreadable weight or rating is left out, like any malformed ad."""
    keys = [c for c in ads.columns if c not in ("ad", "ad_no", "max_pages")]
    a = {name: _attr(name) for name in ("shippable", "shipping_cost", "estimated_parcel_weight", "rating_score", "rating_count",
                                        "stock_quantity", "purchase_cta_visible")}
    made = F.struct(*[v.alias(f"a_{k}") for k, v in a.items()], _attr("transaction_status", True).alias("a_tx"), _attr("condition", True).alias("a_condition"))
    rows = ads.select("*", once(made).alias("made")).select("*", "made.*")
    weight = F.when(F.col("a_estimated_parcel_weight") != "", F.col("a_estimated_parcel_weight").try_cast("bigint")).otherwise(0)
    rating = F.col("a_rating_score").try_cast("double")
    shippable = F.col("a_shippable") == "true"
    cost = _digits(F.col("a_shipping_cost"))
    paid = F.coalesce(cost > 0, F.lit(False))
    rows = rows.where((~shippable | paid | weight.isNotNull()) & ((F.col("a_rating_score") == "") | rating.isNotNull()))
    listed = F.get("ad.price", F.lit(0))
    status = transaction_status(F.col("a_tx"), F.when(F.coalesce("ad.status", F.lit("active")) == "active", "active").otherwise("gone"))
    list_id = F.col("ad.list_id").cast("string")
    return rows.select(
        *keys, F.lit("lbc").alias("source"), list_id.alias("listing_id"),
        F.coalesce("ad.url", F.concat_ws("/", F.lit(f"{SITE}/ad"), "ad.category_id", list_id)).alias("url"),
        F.coalesce("ad.subject", F.lit("")).alias("title"), F.coalesce("ad.body", F.lit("")).alias("description"),
        F.coalesce(F.round(listed * 100).cast("bigint"), F.col("ad.price_cents"), F.lit(0).cast("bigint")).alias("price_cents"),
        F.when(~shippable, F.lit(0).cast("bigint")).when(paid, cost).otherwise(
            weight_shipping_cents(weight, weight_steps, default_cents)).alias("shipping_cents"),
        (shippable & ~paid).alias("shipping_estimated"),
        F.when(shippable, F.coalesce("ad.buyer_fee.amount", F.lit(0).cast("bigint"))).otherwise(0).cast("bigint").alias("fees_cents"),
        F.col("a_condition").alias("condition"), condition_from_label(F.col("a_condition")).alias("condition_code"),
        F.coalesce("ad.owner.name", F.lit("")).alias("seller_name"),
        F.when(F.col("ad.owner.type") == "pro", "pro").otherwise("private").alias("seller_type"),
        F.round(rating * 100).cast("bigint").alias("seller_rating"), _digits(F.col("a_rating_count")).alias("seller_reviews"),
        F.coalesce(F.when(F.col("ad.location.city_label") != "", F.col("ad.location.city_label")), F.col("ad.location.city"), F.lit("")).alias("location"),
        F.coalesce("ad.location.country_id", F.lit("FR")).alias("country"),
        shippable.alias("delivery"), (F.col("a_purchase_cta_visible") == "true").alias("secure_payment"),
        _digits(F.col("a_stock_quantity")).alias("stock"), status.alias("status"),
        F.coalesce("ad.first_publication_date", F.lit("")).alias("posted_at"))


def ad_details(pages: DataFrame) -> DataFrame:
    """Detail pages to detail rows: description and the transaction badge."""
    good, _ = read_islands(pages)
    keys = [c for c in good.columns if c != "page"]
    rows = good.select(*keys, F.col("page.ad").alias("ad")).where(F.col("ad").isNotNull())
    return rows.select(*keys, F.when(F.col("ad.body") != "", F.col("ad.body")).alias("description"),
                       transaction_status(_attr("transaction_status", True), F.lit("active")).alias("status"))



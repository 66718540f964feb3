"""Search API pages and item details in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.listing import condition_from_id
from pricelens.functions.text import html_to_text

SHIP = "ARRAY<STRUCT<shippingCostType: STRING, shippingCost: STRUCT<value: STRING, currency: STRING>>>"
ITEM_DDL = (
    "itemId STRING, title STRING, price STRUCT<value: STRING, currency: STRING>, condition STRING, conditionId STRING, "
    "itemWebUrl STRING, itemLocation STRUCT<city: STRING, country: STRING>, "
    "seller STRUCT<username: STRING, feedbackPercentage: STRING, feedbackScore: BIGINT, sellerAccountType: STRING>, "
    f"shippingOptions {SHIP}, itemCreationDate STRING"
)
PAGE_DDL = f"total BIGINT, `limit` BIGINT, offset BIGINT, itemSummaries ARRAY<STRUCT<{ITEM_DDL}>>"
DETAIL_DDL = (
    "mpn STRING, localizedAspects ARRAY<STRUCT<name: STRING, value: STRING>>, description STRING, "
    "estimatedAvailabilities ARRAY<STRUCT<estimatedAvailableQuantity: BIGINT>>, "
    "returnTerms STRUCT<returnsAccepted: BOOLEAN, returnPeriod: STRUCT<value: STRING, unit: STRING>>, "
    f"shippingOptions {SHIP}, seller STRUCT<sellerAccountType: STRING>"
)


def _cents(value: Column) -> Column:
    return F.round(value.try_cast("decimal(18,4)") * 100).cast("bigint")


def _first_cost(options: Column, euro_only: bool) -> Column:
    def usable(o: Column) -> Column:
        ok = o["shippingCost"]["value"].isNotNull()
        return ok & (F.coalesce(o["shippingCost"]["currency"], F.lit("EUR")) == "EUR") if euro_only else ok

    return _cents(F.get(F.filter(options, usable), F.lit(0))["shippingCost"]["value"])


def api_listings(pages: DataFrame) -> DataFrame:
    """Items of search pages to listing columns; prices in another currency than the euro are dropped."""
    keys = [c for c in pages.columns if c != "body"]
    items = pages.select(*keys, F.from_json("body", PAGE_DDL).alias("page")).select(
        *keys, F.posexplode_outer("page.itemSummaries").alias("item_no", "item"))
    euro = items.where(F.col("item").isNotNull() & (F.coalesce("item.price.currency", F.lit("EUR")) == "EUR"))
    pct = F.col("item.seller.feedbackPercentage")
    return euro.select(
        *keys, F.lit("ebay").alias("source"), F.col("item.itemId").alias("listing_id"), F.coalesce("item.itemWebUrl", F.lit("")).alias("url"),
        F.coalesce("item.title", F.lit("")).alias("title"), F.lit("").alias("description"),
        F.coalesce(_cents(F.col("item.price.value")), F.lit(0).cast("bigint")).alias("price_cents"),
        _first_cost(F.col("item.shippingOptions"), True).alias("shipping_cents"), F.lit(False).alias("shipping_estimated"),
        F.lit(0).cast("bigint").alias("fees_cents"), F.coalesce("item.condition", F.lit("")).alias("condition"),
        condition_from_id(F.coalesce("item.conditionId", F.lit(""))).alias("condition_code"),
        F.coalesce("item.seller.username", F.lit("")).alias("seller_name"),
        F.when(F.col("item.seller.sellerAccountType") == "BUSINESS", "pro").otherwise("").alias("seller_type"),
        F.when(pct != "", pct.try_cast("double")).alias("seller_rating"), F.col("item.seller.feedbackScore").alias("seller_reviews"),
        F.concat_ws(", ", F.when(F.col("item.itemLocation.city") != "", F.col("item.itemLocation.city")),
                    F.when(F.col("item.itemLocation.country") != "", F.col("item.itemLocation.country"))).alias("location"),
        F.coalesce("item.itemLocation.country", F.lit("")).alias("country"), F.lit(True).alias("delivery"), F.lit(True).alias("secure_payment"),
        F.lit(None).cast("bigint").alias("stock"), F.lit("active").alias("status"), F.coalesce("item.itemCreationDate", F.lit("")).alias("posted_at"))


def api_details(items: DataFrame) -> DataFrame:
    """Item details to detail rows: part number, aspects and description as one text, stock, returns, shipping."""
    keys = [c for c in items.columns if c != "body"]
    d = items.select(*keys, F.from_json("body", DETAIL_DDL).alias("d"))
    aspects = F.filter(F.coalesce("d.localizedAspects", F.array().cast("array<struct<name:string,value:string>>")),
                       lambda a: (a["name"] != "") & (a["value"] != ""))
    parts = F.concat(
        F.array(F.when(F.col("d.mpn") != "", F.concat(F.lit("MPN: "), F.col("d.mpn")))),
        F.transform(aspects, lambda a: F.concat_ws(": ", a["name"], a["value"])),
        F.array(F.when(F.col("d.description") != "", F.substring(html_to_text(F.col("d.description")), 1, 4000))))
    period = F.concat_ws(" ", F.lit("acceptés"), F.col("d.returnTerms.returnPeriod.value"), F.lower("d.returnTerms.returnPeriod.unit"))
    return d.select(
        *keys, F.array_join(F.array_compact(parts), "\n").alias("description"),
        F.get("d.estimatedAvailabilities", F.lit(0))["estimatedAvailableQuantity"].alias("stock"),
        F.when(F.col("d.returnTerms").isNull(), None).when(F.col("d.returnTerms.returnsAccepted"), F.trim(period))
        .otherwise("non acceptés").alias("returns"),
        _first_cost(F.col("d.shippingOptions"), False).alias("shipping_cents"),
        F.when(F.col("d.seller.sellerAccountType") == "BUSINESS", "pro").when(F.col("d.seller.sellerAccountType") != "", "private")
        .alias("seller_type"))

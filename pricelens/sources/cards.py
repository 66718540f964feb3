"""Card grids whose link titles hold title, attributes and prices; item pages with product JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.listing import condition_from_label
from pricelens.functions.literals import once
from pricelens.functions.parse import price_text_cents
from pricelens.functions.text import unescape_html

SITE = "https://www.vinted.fr"
# Trailing pairs are the longest run of ", Name: value" segments that ends the text.
PAIRS = fv.CARD_PAIR.replace("(?U)", "").rstrip("$").replace("([A-Z", "(?:[A-Z").replace("([^,]*)", "[^,]*")


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, f'(?<![a-zA-Z-]){name}="([^"]*)"', 1)


def cards(pages: DataFrame) -> DataFrame:
    """Priced cards of each page, the first one per id."""
    keys = [c for c in pages.columns if c != "body"]
    tags = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(fv.CARD_TAG), F.lit(0))
    rows = pages.select(*keys, F.posexplode(tags).alias("card_no", "tag"))
    text = F.trim(unescape_html(_attribute(F.col("tag"), "title")))
    rows = rows.select("*", once(text).alias("text")).where(F.col("text").rlike(fv.CARD_PRICES))
    rest = F.regexp_replace("text", fv.CARD_PRICES, "")
    rows = rows.select(
        *keys, "card_no", F.regexp_extract("tag", fv.CARD_TAG, 1).alias("id"),
        F.regexp_replace(unescape_html(_attribute(F.col("tag"), "href")), "\\?.*$", "").alias("href"),
        once(price_text_cents(F.regexp_extract("text", fv.CARD_PRICES, 1))).alias("price_cents"),
        price_text_cents(F.regexp_extract("text", fv.CARD_PRICES, 2)).alias("total_cents"), rest.alias("rest"),
    ).where(F.col("price_cents").isNotNull())
    return rows.withColumn("pairs", F.regexp_extract("rest", f"(?U)((?:{PAIRS})*)$", 1)).withColumn(
        "title", F.trim(F.regexp_replace("rest", f"(?U)(?:{PAIRS})+$", "")))


def card_listings(pages: DataFrame, shipping_cents: int | None = 890) -> DataFrame:
    """Cards to listing columns; the buyer fee is the difference of the two prices when it is positive."""
    found = cards(pages)
    keys = [c for c in pages.columns if c != "body"]
    condition = F.trim(F.regexp_extract("pairs", "(?U),\\s*État:\\s*([^,]*)", 1))
    ship = F.lit(shipping_cents).cast("bigint")
    rows = found.select(
        *keys, "card_no", F.lit("vinted").alias("source"), F.col("id").alias("listing_id"),
        F.when(F.col("href").startswith("http"), F.col("href")).otherwise(
            F.concat(F.lit(SITE), F.coalesce(F.when(F.col("href") != "", F.col("href")), F.concat(F.lit("/items/"), "id")))).alias("url"),
        "title", F.lit("").alias("description"), "price_cents", ship.alias("shipping_cents"), F.lit(shipping_cents is not None).alias("shipping_estimated"),
        F.greatest(F.coalesce(F.col("total_cents") - F.col("price_cents"), F.lit(0)), F.lit(0)).cast("bigint").alias("fees_cents"),
        condition.alias("condition"), condition_from_label(condition, False).alias("condition_code"),
        F.trim(F.regexp_extract("pairs", "(?U),\\s*Marque:\\s*([^,]*)", 1)).alias("brand"),
        F.lit("private").alias("seller_type"), F.lit(True).alias("delivery"), F.lit(True).alias("secure_payment"), F.lit("active").alias("status"))
    return rows


def first_cards(listings: DataFrame, page_key: list[str]) -> DataFrame:
    """The first priced card per id of each page."""
    rest = [c for c in listings.columns if c not in (*page_key, "listing_id")]
    return listings.groupBy(*page_key, "listing_id").agg(F.min_by(F.struct(*rest), "card_no").alias("r")).select(
        *page_key, "listing_id", "r.*")


def item_details(pages: DataFrame) -> DataFrame:
    """Item pages to detail rows: description, worst status, seller reputation and number of ratings."""
    keys = [c for c in pages.columns if c != "body"]
    blocks = F.regexp_extract_all("body", F.lit(fv.PRODUCT_JSON), F.lit(1))
    ddl = "`@type` STRING, description STRING, offers STRUCT<availability: STRING>"
    product = F.get(F.filter(F.transform(blocks, lambda b: F.from_json(b, ddl)), lambda p: p["@type"] == "Product"), F.lit(0))
    rows = pages.select(*keys, "body", product.alias("p"))
    gone = F.lower(F.coalesce("p.offers.availability", F.lit("")))
    reputation = F.regexp_extract("body", fv.ITEM_REPUTATION, 1)
    return rows.select(
        *keys, F.when(F.col("p.description") != "", F.col("p.description")).alias("description"),
        F.when(gone.contains("soldout") | gone.contains("outofstock"), "sold").when(F.col("body").rlike(fv.ITEM_RESERVED), "pending")
        .otherwise("active").alias("status"),
        F.round(F.when(reputation != "", reputation.try_cast("double")) * 100, 1).alias("seller_rating"),
        F.regexp_extract("body", fv.ITEM_FEEDBACK, 1).try_cast("bigint").alias("seller_reviews"))

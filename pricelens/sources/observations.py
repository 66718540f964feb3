"""The observation log: one row per sighting of an offer, read from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("lbc", "ebay", "vinted", "hfr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as the job asks for in ``spark.pricelens.inputPartitions``; as they are read when it does not.

    For single files of one row group, which Spark cannot split, on a machine with several cores. Unset on a cluster."""
    n = df.sparkSession.conf.get("spark.pricelens.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def source_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SOURCES)), (number % 4 + 1).cast("int"))


def observation_log(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Sightings from line items: part type is the watch, supplier the source, part the listing, month the scan.

    ``lines`` replaces the stored line items, for a micro-batch of them.
    """
    line = (lines if lines is not None else dealt(table(spark, sf_dir, "lineitem"))).select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("ln"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("ext"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("seen_at"))
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint").alias("size"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    df = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)

    ln, size, kind = F.col("ln"), F.col("size"), F.col("size") % 7
    price = F.call_function("div", F.col("ext"), F.col("qty"))
    source = source_name(F.col("l_suppkey"))
    quantity = F.when(ln >= 6, 2).otherwise(1).cast("bigint")
    known = F.col("s_acctbal") >= 0
    posted = F.date_format(F.date_sub(F.to_date("seen_at"), (F.col("qty") * 5).cast("int")), "yyyy-MM-dd")
    flag = F.element_at(F.array(*map(F.lit, ["", "multi_capacity", "ref_missing", "low_tier", "ref_unverified",
                                             "model_unknown", ""])), (kind + 1).cast("int"))
    df = df.select(
        F.col("p_type").alias("watch"), source.alias("source"), F.col("l_partkey").cast("string").alias("listing_id"),
        F.trunc(F.to_date("seen_at"), "month").alias("scan_id"),
        (F.col("l_orderkey") * 10 + ln).alias("obs_id"), "seen_at",
        F.concat(F.lit("https://market.example/"), source, F.lit("/"), F.col("l_partkey").cast("string")).alias("url"),
        F.concat_ws(" ", "p_name", "p_brand").alias("title"),
        F.when(ln % 2 == 0, F.concat(F.lit("lot "), ln.cast("string"))).otherwise("").alias("description"),
        price.alias("price_cents"),
        F.when(F.col("tax") > 0, F.call_function("div", price * F.col("tax"), F.lit(100))).alias("shipping_cents"),
        (source.isin("lbc", "vinted") & (F.col("tax") > 0)).alias("shipping_estimated"),
        F.call_function("div", price * F.col("disc"), F.lit(100)).alias("fees_cents"),
        quantity.alias("quantity"),
        F.element_at(F.array(*map(F.lit, ["Neuf", "Très bon état", "Pour pièces", ""])), (ln % 4 + 1).cast("int"))
        .alias("condition"),
        F.element_at(F.array(*map(F.lit, ["1000", "2010", "3000", "7000", "9999"])), (ln % 5 + 1).cast("int"))
        .alias("condition_id"),
        F.col("s_name").alias("seller_name"),
        F.when(F.col("s_nationkey") % 2 == 0, "pro").otherwise("private").alias("seller_type"),
        F.when(known, F.lit(90) + F.col("l_suppkey") % 11).alias("seller_rating"),
        F.when(known, F.floor(F.col("s_acctbal") / 1000)).alias("seller_reviews"),
        F.concat(F.lit("Ville "), F.col("s_nationkey").cast("string")).alias("location"),
        F.when(ln % 5 == 0, None).when((F.col("l_linestatus") == "F") & (ln % 3 == 0), False).otherwise(True)
        .alias("delivery"),
        F.when(source == "hfr", None).otherwise(ln % 3 != 0).alias("secure_payment"),
        F.when(F.col("l_returnflag") == "A", "pending").when(F.col("l_returnflag") == "R", "sold").otherwise("active")
        .alias("status"),
        F.when(source == "lbc", F.concat(posted, F.lit(" 00:00:00")))
        .when(source == "ebay", F.concat(posted, F.lit("T00:00:00.000Z")))
        .when(source == "hfr", F.concat(posted, F.lit("T00:00:00+01:00"))).otherwise("").alias("posted_at"),
        F.when(size % 10 == 0, "reject").otherwise("accept").alias("verdict"),
        F.when(~kind.isin(2, 5), F.col("p_name")).alias("model"),
        F.when(kind != 5, F.col("p_brand")).alias("family"),
        F.when(size % 3 != 0, F.col("p_brand")).alias("brand"),
        F.filter(F.array(flag, F.when(quantity > 1, "lot").otherwise("")), lambda f: f != "").alias("flags"),
    )
    return df


def scan_is_complete(scan_id: Column, source: Column) -> Column:
    """Completeness bit of the test log: one scan in five of each source was cut short."""
    number = F.array_position(F.array(*map(F.lit, SOURCES)), source)
    return (F.month(scan_id) + number) % 5 != 0

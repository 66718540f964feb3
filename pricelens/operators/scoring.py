"""Tiering, filters, notes and scam rules over classified listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.listing import age_days
from pricelens.functions.money import plain_number, delivered_cents, lot_divisor, rounded_div, whole_euros

# Flags that lower the priority, and the French note texts.
LOW_FLAGS = ("model_unknown", "low_tier", "ref_unverified")
NOTE_SHIPPING_UNKNOWN = "port inconnu"
NOTE_SHIPPING_ESTIMATED = "port estimé"
NOTE_NO_DELIVERY = "pas de livraison"
NOTE_ASK_REFERENCE = "demander la référence exacte"
NOTE_ASK_SMART = " et une capture SMART"
NOTE_UNVERIFIED = "référence hors catalogue : vérifier avant d'acheter"
NOTE_LOW_TIER = "gamme inférieure"
NOTE_CAPACITIES = "plusieurs capacités citées"
SCAM_NO_REVIEWS = "vendeur sans évaluation et prix sous le marché"
SCAM_NO_TRACE = "ni livraison, ni paiement sécurisé, vendeur sans historique"


def with_prices(df: DataFrame) -> DataFrame:
    """Delivered price and price per item, in cents."""
    return df.withColumn(
        "delivered_cents", delivered_cents(F.col("price_cents"), F.col("shipping_cents"), F.col("fees_cents"))
    ).withColumn("lot_divisor", lot_divisor(F.col("quantity"), F.col("flags"))).withColumn(
        "unit_cents", rounded_div(F.col("delivered_cents"), F.col("lot_divisor"))
    )


def per_unit_cents(unit: Column, divisor: Column) -> Column:
    """Price per profile unit (€/To...), half up; the divisor may be a fraction; null without one."""
    return F.when(divisor > 0, F.floor(unit / divisor + 0.5).cast("bigint"))


def tier_for(unit: Column, tiers: Column) -> Column:
    """First tier (sorted by cap, inclusive) that holds the price; null above the last cap."""
    return F.get(F.filter(tiers, lambda t: unit <= t["max_cents"]), F.lit(0))


def with_decision(df: DataFrame, watches: DataFrame) -> DataFrame:
    """Verdict, tier, filters and notes for each row; ``watches`` has one row per configured watch.

    The checks run in order: rejected, over the last cap, under the floor, too old, not delivered.
    """
    df = with_prices(df.join(F.broadcast(watches), "watch"))
    flags = F.col("flags")
    df = df.withColumn("tier_row", tier_for(F.col("unit_cents"), F.col("tiers"))).withColumn(
        "age_days", age_days(F.col("posted_at"), F.col("seen_at")))
    stage = (
        F.when(F.col("verdict") != "accept", "reject")
        .when(F.col("tier_row").isNull(), "over_cap")
        .when((F.col("min_unit_cents") > 0) & (F.col("unit_cents") < F.col("min_unit_cents")), "below_floor")
        .when((F.col("max_age_days") > 0) & (F.col("age_days") > F.col("max_age_days")), "too_old")
        .when(F.col("require_delivery") & (F.col("delivery") == F.lit(False)), "no_delivery")
        .otherwise("kept")
    )
    df = df.withColumn("stage", stage).withColumn("keep", F.col("stage") == "kept")
    low = F.arrays_overlap(flags, F.concat(F.array(*map(F.lit, LOW_FLAGS)), F.col("low_flags")))
    return df.select(
        "*",
        F.when(F.col("stage") == "reject", "reject").when(F.col("keep"), F.col("tier_row.priority"))
        .otherwise("ignore").alias("tier"),
        F.when(~F.col("keep"), "none").when(low, "low").otherwise(F.col("tier_row.priority")).alias("priority"),
        F.when(F.col("keep"), F.col("tier_row.tags")).otherwise(F.array().cast("array<string>")).alias("tags"),
        per_unit_cents(F.col("unit_cents"), F.col("unit_divisor")).alias("per_unit_cents"),
        decision_notes().alias("notes"),
    )


def decision_notes() -> Column:
    """Ordered notes; what is said depends on how far the row went through the checks."""
    flags = F.col("flags")

    def has(flag: str) -> Column:
        return F.array_contains(flags, flag)

    def text(*parts: Column | str) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    mixed = (F.col("quantity") > 1) & has("multi_capacity")
    always = F.array(
        F.when(mixed, text("lot mixte de ", F.col("quantity").cast("string"), " articles, prix total non divisé")),
        F.when(F.col("shipping_cents").isNull(), NOTE_SHIPPING_UNKNOWN).when(
            F.col("shipping_estimated"), NOTE_SHIPPING_ESTIMATED),
    )
    stopped = F.array(
        F.when(F.col("stage") == "below_floor",
               text("sous le prix plancher (", whole_euros(F.col("min_unit_cents")),
                    " €) : accessoire ou annonce factice"))
        .when(F.col("stage") == "too_old", text("annonce publiée il y a ", F.col("age_days").cast("string"), " jours"))
        .when(F.col("stage") == "no_delivery", NOTE_NO_DELIVERY)
    )
    ask = F.when(F.col("profile") == "hdd", NOTE_ASK_REFERENCE + NOTE_ASK_SMART).otherwise(NOTE_ASK_REFERENCE)
    kept = F.concat(
        F.array(
            F.when(has("model_unknown") | has("ref_missing"), ask),
            F.when(has("ref_unverified"), NOTE_UNVERIFIED),
            F.when(has("low_tier"), NOTE_LOW_TIER),
        ),
        F.transform(F.filter(flags, lambda f: F.map_contains_key(F.col("flag_notes"), f)),
                    lambda f: F.element_at(F.col("flag_notes"), f)),
        F.array(
            F.when(F.col("lot_divisor") > 1,
                   text("lot de ", F.col("lot_divisor").cast("string"), " : ",
                        whole_euros(F.col("delivered_cents")), " € au total")),
            F.when(has("multi_capacity"), NOTE_CAPACITIES),
        ),
    )
    return F.array_compact(F.concat(always, F.when(F.col("keep"), kept).otherwise(stopped)))


def with_scam_flags(df: DataFrame) -> DataFrame:
    """Scam rules on kept rows. Uses ``median_cents`` / ``median_samples`` when present, else the reference price."""
    columns = df.columns
    median = F.col("median_cents") if "median_cents" in columns else F.lit(None).cast("double")
    samples = F.col("median_samples") if "median_samples" in columns else F.lit(0)
    fallback = F.when(F.col("reference_cents") > 0, F.col("reference_cents").cast("double"))
    market = F.when(median.isNotNull() & (samples >= F.col("min_samples")), median).otherwise(fallback)
    market = F.when(market > 0, market)
    df = df.withColumn("market_cents", market)
    unit, ship, price = F.col("unit_cents"), F.coalesce(F.col("shipping_cents"), F.lit(0)), F.col("price_cents")
    no_reviews = F.coalesce(F.col("seller_reviews"), F.lit(0)) == 0
    pct = F.col("below_median_pct")
    rules = F.array(
        F.when(unit * 100 < F.col("market_cents") * pct,
               F.concat(F.lit("prix "), whole_euros(unit), F.lit(" € < "), plain_number(pct),
                        F.lit("% de la médiane ("), whole_euros(F.col("market_cents")), F.lit(" €)"))),
        F.when(F.col("zero_feedback_below_market") & no_reviews & (unit < F.col("market_cents")), SCAM_NO_REVIEWS),
        F.when((ship > F.col("max_shipping_cents")) | ((price > 0) & (ship * 100 > price * F.col("max_shipping_pct"))),
               F.concat(F.lit("frais de port aberrants ("), whole_euros(ship), F.lit(" €)"))),
        F.when((F.col("delivery") == F.lit(False)) & (F.col("secure_payment") == F.lit(False)) & no_reviews,
               SCAM_NO_TRACE),
    )
    none = F.array().cast("array<string>")
    return df.withColumn("suspicious", F.when(F.col("keep"), F.array_compact(rules)).otherwise(none))


def score(df: DataFrame, watches: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Full decision for classified listings, against a market snapshot when one is given."""
    from pricelens.operators.market import attach_market

    decided = with_decision(df, watches)
    if market is not None:
        decided = attach_market(decided, market)
    return with_scam_flags(decided)

"""Alert texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.functions.listing import listing_label
from pricelens.functions.money import format_per_unit, format_price

# Push priorities.
PRIORITIES = {"urgent": 5, "high": 4, "default": 3, "low": 2, "min": 1}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def attribute_lines(attrs: Column, labels: Column) -> Column:
    """'Label : value' for the attributes that have a value and a label, in the order of ``labels`` (name, label); none where either is null."""
    def line(x: Column) -> Column:
        value = F.try_element_at(attrs, x["name"])
        return F.when(value != "", _text(x["label"], " : ", value))

    return F.coalesce(F.array_compact(F.transform(labels, line)), F.array().cast("array<string>"))


def alert_title(labels: dict[str, str]) -> Column:
    source = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("source")),
                        F.upper("source"))
    name = listing_label(F.col("family"), F.col("model"), F.col("brand"))
    per = format_per_unit(F.col("per_unit_cents"), F.col("unit_label"))
    return _text(
        F.when(F.size("suspicious") > 0, "⚠️ ").otherwise(""),
        F.when(F.col("event") == "price_drop", "↓ ").otherwise(""),
        F.when(F.col("watch_label") != "", _text("[", F.col("watch_label"), "] ")).otherwise(""),
        "[", source, "] ", name, " — ", format_price(F.col("unit_cents")),
        F.when(F.col("quantity") > 1, _text(" ×", F.col("quantity").cast("string"))).otherwise(""),
        F.when(per != "", _text(" (", per, ")")).otherwise(""))


def alert_body(extra_lines: Column | None = None) -> Column:
    """Body lines in their fixed order; absent facts leave no line."""
    ship = F.when(F.col("shipping_cents").isNull(), "inconnu").otherwise(
        _text(format_price(F.col("shipping_cents")), F.when(F.col("shipping_estimated"), " est.").otherwise("")))
    fees = F.when(F.col("fees_cents") > 0, _text(" + frais ", format_price(F.col("fees_cents")))).otherwise("")
    rating = F.coalesce(_text(F.round("seller_rating").cast("bigint").cast("string"), " %"), F.lit("?"))
    rated = F.col("seller_rating").isNotNull() | F.col("seller_reviews").isNotNull()
    seller = _text(
        F.when(F.col("seller_name") != "", F.col("seller_name")).otherwise("?"),
        F.when(rated, _text(" (", rating, ", ", F.coalesce(F.col("seller_reviews").cast("string"), F.lit("?")), " avis)"))
        .otherwise(""),
        F.when(F.col("seller_type") != "", _text(" · ", F.col("seller_type"))).otherwise(""))
    lines = F.array(
        _text("Modèle : ", listing_label(F.col("family"), F.col("model"), F.col("brand"))),
        _text("Prix rendu : ", format_price(F.col("delivered_cents")), " (", format_price(F.col("price_cents")), " + port ",
              ship, fees, ")"),
        F.when(F.col("quantity") > 1, _text("Lot de ", F.col("quantity").cast("string"), " → ",
                                            format_price(F.col("unit_cents")), " par article")),
        F.when((F.col("event") == "price_drop") & F.col("prev_cents").isNotNull(),
               _text("Avant : ", format_price(F.col("prev_cents")), " par article")),
        F.when(F.col("condition") != "", _text("État : ", F.col("condition"))),
        _text("Vendeur : ", seller),
        F.when(F.col("location") != "", _text("Lieu : ", F.col("location"))),
        F.when(F.col("delivery"), "Livraison : oui").when(~F.col("delivery"), "Livraison : non"),
        F.when(F.col("stock") > 1, _text("Stock : ", F.col("stock").cast("string"))),
        F.when(F.col("returns") != "", _text("Retours : ", F.col("returns"))),
    )
    parts = [lines]
    if extra_lines is not None:
        parts.append(extra_lines)
    parts += [F.transform("notes", lambda n: F.concat(F.lit("• "), n)),
              F.transform("suspicious", lambda s: F.concat(F.lit("⚠ "), s))]
    return F.array_join(F.array_compact(F.concat(*parts)), "\n")


def alert_priority() -> Column:
    level = F.when(F.size("suspicious") > 0, "low").otherwise(F.col("priority"))
    number = F.lit(3)
    for name, value in PRIORITIES.items():
        number = F.when(level == name, F.lit(value)).otherwise(number)
    return number


def alert_tags() -> Column:
    return F.array_compact(F.concat(
        F.array("source"), F.col("tags"),
        F.array(F.when(F.col("event") == "price_drop", "arrow_down"), F.when(F.size("suspicious") > 0, "warning"))))

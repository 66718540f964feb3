"""Prices and local times out of marketplace text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.literals import let


def price_text_cents(text: Column) -> Column:
    """'1 099,00', '1.300,50', '1,300.50' to cents; the first of two separators groups thousands."""
    def number(s: Column) -> Column:
        comma, dot = F.instr(s, ","), F.instr(s, ".")
        plain = (
            F.when((comma > 0) & (dot > 0) & (comma < dot), F.replace(s, F.lit(","), F.lit("")))
            .when((comma > 0) & (dot > 0), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .otherwise(F.replace(s, F.lit(","), F.lit(".")))
        )
        return F.when(s != "", F.round(plain.try_cast("double") * 100).cast("bigint"))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", ""), number)


def topic_price(text: Column) -> Column:
    """First amount of a forum line in whole euros (decimals dropped); zero or none is null."""
    def euros(found: Column) -> Column:
        value = F.when(found != "", F.regexp_replace(found, "(?U)[\\s.]", "").try_cast("bigint"))
        return let(value, lambda v: F.when(v > 0, v))

    amount = F.regexp_extract(text, fv.TOPIC_PRICE, 1)
    label = F.regexp_extract(text, fv.TOPIC_PRICE_LABEL, 1)
    return let(let(amount, lambda a: F.when(a != "", a).otherwise(label)), euros)


def paris_time(text: Column) -> Column:
    """'28-09-2026 à 16:42' in Paris to an instant; unreadable text is null."""
    day, hour = F.regexp_extract(text, fv.TOPIC_DATE, 1), F.regexp_extract(text, fv.TOPIC_DATE, 2)
    return F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, hour), F.lit("dd-MM-yyyy HH:mm")), "Europe/Paris")

"""Money in whole cents, and its French text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def delivered_cents(price: Column, shipping: Column, fees: Column) -> Column:
    """Item price + shipping + buyer fees; unknown amounts count as zero."""
    return price + F.coalesce(shipping, F.lit(0)) + F.coalesce(fees, F.lit(0))


def rounded_div(amount: Column, by: Column) -> Column:
    """Integer division rounded half up (amounts are never negative)."""
    return F.call_function("div", amount * 2 + by, by * 2)


def lot_divisor(quantity: Column, flags: Column) -> Column:
    """Items to divide a lot by; a lot mixing capacities is not divided."""
    mixed = (quantity > 1) & F.array_contains(flags, "multi_capacity")
    return F.when(mixed, F.lit(1)).otherwise(F.greatest(F.lit(1), quantity)).cast("bigint")


def whole_euros(cents: Column) -> Column:
    """Euros without decimals, as text."""
    return F.floor((cents + 50) / 100).cast("bigint").cast("string")


def plain_number(number: Column) -> Column:
    """A setting as text, without a trailing '.0'."""
    return F.regexp_replace(number.cast("string"), "\\.0$", "")


def format_price(cents: Column) -> Column:
    """'1 234,50 €', without ',00'; '?' when unknown."""
    text = F.translate(F.format_number(cents.cast("decimal(20,0)") / 100, 2), ",.", " ,")
    return F.when(cents.isNull(), F.lit("?")).otherwise(F.concat(F.regexp_replace(text, ",00$", ""), F.lit(" €")))


def format_per_unit(cents: Column, label: Column) -> Column:
    """'23,50 €/To' for a title; empty when the profile has no unit."""
    text = F.translate(F.format_string("%.2f", cents / 100), ".", ",")
    out = F.trim(F.concat_ws(" ", F.regexp_replace(text, ",00$", ""), label))
    return F.when(cents.isNull(), F.lit("")).otherwise(out)

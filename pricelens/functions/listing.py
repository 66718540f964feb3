"""Scalar expressions over one listing row: status, age, condition, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status ranks (higher is worse) and marketplace condition ids.
STATUS_RANK = {"active": 0, "gone": 1, "pending": 2, "sold": 3}
CONDITION_IDS = {
    "new": ("1000", "1500", "1750"),
    "refurb": ("2000", "2010", "2020", "2030", "2500", "2750"),
    "used": ("3000", "4000", "5000", "6000"),
    "parts": ("7000",),
}


def status_rank(status: Column) -> Column:
    rank = F.lit(0)
    for name, value in STATUS_RANK.items():
        rank = F.when(status == name, F.lit(value)).otherwise(rank)
    return rank


def status_of_rank(rank: Column) -> Column:
    names = F.array(*[F.lit(s) for s, _ in sorted(STATUS_RANK.items(), key=lambda kv: kv[1])])
    return F.element_at(names, (rank + 1).cast("int"))


def worst_status(first: Column, second: Column) -> Column:
    """The worse of two statuses; on equal ranks the first one."""
    return F.when(status_rank(first) >= status_rank(second), first).otherwise(second)


def posted_instant(posted_at: Column) -> Column:
    """ISO text, with or without offset, to an instant; text without offset is UTC; unreadable is null."""
    text = F.regexp_replace(F.trim(posted_at), "^(\\S+) (\\S)", "$1T$2")
    dated = F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}"), text)
    return F.try_to_timestamp(dated).cast("timestamp")


def age_days(posted_at: Column, as_of: Column) -> Column:
    """Whole days between publication and ``as_of``, never negative; null when the date is unknown."""
    seconds = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(posted_instant(posted_at))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0), F.floor(seconds / 86400))).cast("bigint")


def condition_from_label(label: Column, parts_words: bool = True) -> Column:
    """Condition code from a French label; only some sources sell parts."""
    low = F.lower(F.coalesce(label, F.lit("")))
    code = F.when(low.contains("neuf"), "new").when(low != "", "used").otherwise("unknown")
    if parts_words:
        code = F.when(low.contains("pièce") | low.contains("piece"), "parts").otherwise(code)
    return code


def condition_from_id(condition_id: Column) -> Column:
    code = F.lit("unknown")
    for name, ids in CONDITION_IDS.items():
        code = F.when(condition_id.isin(*ids), name).otherwise(code)
    return code


def listing_label(family: Column, model: Column, brand: Column) -> Column:
    """Display name: family and model, then whichever is known."""
    fam = F.when(family != "", family)
    mod = F.when(model != "", model)
    brd = F.when(brand != "", brand)
    named = F.when(fam.isNotNull(), F.concat_ws(" ", fam, F.coalesce(mod, F.lit("(réf. ?)"))))
    return F.coalesce(
        named,
        mod,
        F.concat(brd, F.lit(" modèle inconnu")),
        F.lit("Modèle inconnu"),
    )


def weight_shipping_cents(weight_g: Column, steps: list[tuple[int, int]], default_cents: int) -> Column:
    """Shipping from a parcel weight: first step that holds it; the default when unknown or too heavy."""
    cost = F.lit(default_cents).cast("bigint")
    for limit, cents in sorted(steps, reverse=True):
        cost = F.when((weight_g > 0) & (weight_g <= limit), F.lit(cents).cast("bigint")).otherwise(cost)
    return cost

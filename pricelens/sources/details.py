"""Second pass: detail rows joined to the listings that are worth one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.functions.listing import worst_status

KEY = ["watch", "source", "listing_id"]
DETAIL_COLS = {"description": "string", "stock": "bigint", "returns": "string", "seller_type": "string", "seller_rating": "double",
               "seller_reviews": "bigint", "shipping_cents": "bigint", "status": "string"}


def enrich_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """New and kept rows completed by their details, the other rows as they are.

    The filter stands before the join, so only the few rows that need a detail are shuffled. What the detail
    page says replaces description, stock, returns and seller facts; shipping is only filled in when unknown and
    the status only gets worse. Classify and score the result again.
    """
    wanted = rows.where(F.col("is_new") & F.col("keep"))
    rest = rows.where(~(F.col("is_new") & F.col("keep")))
    known = [c for c in DETAIL_COLS if c in details.columns]
    d = details.select(*KEY, *[F.col(c).alias(f"d_{c}") for c in known], F.lit(True).alias("found"))
    out = wanted.join(d, KEY, "left")
    updates = {}
    for c in known:
        own = F.col(c) if c in rows.columns else F.lit(None).cast(DETAIL_COLS[c])
        if c == "status":
            updates[c] = F.when(F.col("d_status").isNotNull(), worst_status(own, F.col("d_status"))).otherwise(own)
        elif c == "shipping_cents":
            updates[c] = F.coalesce(own, F.col("d_shipping_cents"))
        else:
            updates[c] = F.coalesce(F.col(f"d_{c}"), own)
    out = out.withColumns({**updates, "enriched": F.coalesce("found", F.lit(False))}).drop("found", *[f"d_{c}" for c in known])
    return out.unionByName(rest.withColumn("enriched", F.lit(False)), allowMissingColumns=True)

"""Reports over a listing snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_predicates(df: DataFrame, price_min: int | None, price_max: int | None, condition_ids: list[str],
                      delivered_only: bool = True) -> DataFrame:
    """What a search asks of its source: price window, condition ids (search API only), delivery, still for sale."""
    out = df.where(F.col("status") == "active")
    if price_min is not None:
        out = out.where(F.col("price_cents") >= price_min)
    if price_max is not None:
        out = out.where(F.col("price_cents") <= price_max)
    if condition_ids:
        out = out.where((F.col("source") != "ebay") | F.col("condition_id").isin(*condition_ids))
    return out.where(F.col("delivery")) if delivered_only else out


def listing_search(state: DataFrame, watch: str = "", status: str = "active", keep: str = "1", source: str = "",
                   review: str = "", search: str = "", include_suspicious: bool = True) -> DataFrame:
    """Snapshot rows under optional filters; ``review='none'`` means never reviewed, any other text is exact.

    The search text may hold ``%`` and ``_`` as wildcards and ignores case.
    """
    out = state
    if watch:
        out = out.where(F.col("watch") == watch)
    if status:
        out = out.where(F.col("status") == status)
    if keep in ("0", "1"):
        out = out.where(F.col("keep") == (keep == "1"))
    if source:
        out = out.where(F.col("source") == source)
    if review == "none":
        out = out.where(F.coalesce("review", F.lit("")) == "")
    elif review:
        out = out.where(F.col("review") == review)
    if not include_suspicious:
        out = out.where(F.size("suspicious") == 0)
    if search:
        fields = [F.col(c).ilike(f"%{search}%") for c in ("title", "model", "family", "seller_name", "location", "note")]
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(f, F.lit(False))
        out = out.where(hit)
    return out


def listing_page(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """Cheapest first, newest first among equals, ``limit`` rows, with the real total beside them.

    The limit is a distributed top-k; the total is an uncorrelated scalar subquery, counted on its own.
    """
    page = rows.orderBy(F.col("unit_cents").asc_nulls_first(), F.col("first_seen").desc(), "watch", "source",
                        "listing_id").limit(limit)
    return page.withColumn("total", rows.agg(F.count("*")).scalar())


def listing_sort_any(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Total order on any displayed column; null sorts as empty text does, before everything."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first()
    return rows.orderBy(key, "watch", "source", "listing_id")


def watch_stats(state: DataFrame) -> DataFrame:
    """Counters per watch, and over all watches under an empty name, in one pass over the snapshot."""
    from pricelens.functions.listing import STATUS_RANK

    def tally(column: str, values: list[str]) -> Column:
        """'value:n' pairs of the values that occur, in one text."""
        counts = [F.count_if(F.col(column) == v) for v in sorted(values)]
        return F.concat_ws("|", *[F.when(n > 0, F.concat(F.lit(f"{v}:"), n.cast("string"))) for v, n in zip(sorted(values), counts)])

    return state.rollup("watch").agg(
        F.count("*").alias("listings"),
        F.count_if(F.col("keep") & (F.col("status") == "active")).alias("kept_active"),
        F.count_if(F.col("notify_count") > 0).alias("notified"),
        F.sum("price_points").alias("price_points"),
        tally("status", list(STATUS_RANK)).alias("by_status"),
        tally("verdict", ["accept", "reject"]).alias("by_verdict"),
    ).withColumn("watch", F.coalesce("watch", F.lit("")))


def watch_overview(state: DataFrame, scans: DataFrame, watches: DataFrame, as_of) -> DataFrame:
    """Per watch: kept and active, kept and first seen in the last 24 hours, starred and active, last scan."""
    active = F.col("status") == "active"
    counts = state.groupBy("watch").agg(
        F.count_if(F.col("keep") & active).alias("kept_active"),
        F.count_if(F.col("keep") & (F.col("first_seen") >= as_of - F.expr("INTERVAL 24 HOURS"))).alias("new_today"),
        F.count_if((F.col("review") == "starred") & active).alias("starred"),
    )
    last = scans.groupBy("watch").agg(F.max("scan_id").alias("last_scan"))
    zero = F.lit(0).cast("bigint")
    return watches.select("watch", F.col("watch_title").alias("title")).join(counts, "watch", "left").join(
        last, "watch", "left").select("watch", "title", "last_scan", *[
            F.coalesce(c, zero).alias(c) for c in ("kept_active", "new_today", "starred")])


def scan_counters(lines: DataFrame, alerts: DataFrame, scans: DataFrame, budgets: dict[str, int],
                  gone_after: int = 2) -> DataFrame:
    """Per watch, source and scan: fetched, new, kept, rejected, enriched, notified, gone.

    Sightings of a scan with a second pass say whether they were ``enriched``; without one, as many details are counted as the budget
    would have allowed."""
    from pricelens.operators.history import missed_scan_runs

    group = ["watch", "source", "scan_id"]
    zero = F.lit(0).cast("bigint")
    is_new = F.col("event") == "new"
    came = ~F.col("carried")
    # one pass over the sightings; carried ones count only where they tell that a listing went
    tally = missed_scan_runs(lines, scans, gone_after).groupBy(*group).agg(
        F.count_if(came).alias("fetched"), F.count_if(came & is_new).alias("new"), F.count_if(came & F.col("keep")).alias("kept"),
        F.count_if(came & ~F.col("keep")).alias("rejected"), F.count_if(came & is_new & F.col("keep")).alias("wanted"),
        (F.count_if(came & F.col("enriched")) if "enriched" in lines.columns else F.lit(None).cast("bigint")).alias("read"),
        F.count_if("gone").alias("left"))
    notified = alerts.groupBy(*group).agg(F.count("*").alias("notified"))
    # A run makes the listing gone at the complete scan that is ``gone_after`` complete scans later.
    earlier = Window.partitionBy("watch", "source").orderBy("complete_through").rangeBetween(-gone_after, -gone_after)
    counted = scans.select(*group, "complete", "complete_through").join(tally, group, "left").withColumn(
        "gone", F.when(F.col("complete"), F.sum("left").over(earlier)))
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("source"))
    return counted.join(notified, group, "left").select(
        *group, *[F.coalesce(c, zero).alias(c) for c in ("fetched", "new", "kept", "rejected", "notified", "gone")],
        F.coalesce("read", F.least(F.coalesce("wanted", zero), budget.cast("bigint")) if "enriched" not in lines.columns else zero).alias("enriched"))


def distinct_watches(state: DataFrame) -> DataFrame:
    return state.select("watch").distinct().orderBy("watch")


def digest_rows(state: DataFrame) -> DataFrame:
    """Kept, active, unsuspicious, not dismissed."""
    return state.where(F.col("keep") & (F.col("status") == "active") & (F.size("suspicious") == 0)
                       & (F.coalesce("review", F.lit("")) != "ignored"))


def daily_digest(state: DataFrame, watches: DataFrame, labels: dict[str, str], sent: DataFrame | None = None,
                 local_day: str = "", send_if_empty: bool = False, shown: int = 25) -> DataFrame:
    """One digest message per enabled watch: the ``shown`` cheapest lines and how many more there are.

    ``sent`` (watch, local_day) holds the digests already sent; those are skipped. The rank filter is a constant,
    so each task keeps only its own ``shown`` rows per watch before the shuffle.
    """
    from pricelens.functions.money import format_price

    rows = digest_rows(state)
    totals = rows.groupBy("watch").agg(F.count("*").alias("n"))
    w = Window.partitionBy("watch").orderBy("unit_cents", "source", "listing_id")
    top = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= shown)
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("source")),
                       F.upper("source"))
    name = F.concat_ws(" ", F.when(F.col("family") != "", F.col("family")), F.when(F.col("model") != "", F.col("model")))
    line = F.concat(
        format_price(F.col("unit_cents")),
        F.when(F.col("quantity") > 1, F.concat(F.lit(" ×"), F.col("quantity").cast("string"))).otherwise(""),
        F.lit(" · ["), label, F.lit("] "), F.when(name != "", name).otherwise("Modèle inconnu"), F.lit(" · "),
        F.coalesce("location", F.lit("")), F.lit("\n"), F.col("url"))
    text = top.select("watch", F.struct("position", line.alias("line")).alias("l")).groupBy("watch").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n").alias("body"))
    out = watches.where("enabled").select("watch", "watch_title").join(totals, "watch", "left").join(text, "watch", "left")
    if sent is not None:
        out = out.join(sent.where(F.col("local_day") == local_day).select("watch"), "watch", "left_anti")
    if not send_if_empty:
        out = out.where(F.col("n") > 0)
    plural = F.when(F.col("n") > 1, "s").otherwise("")
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n… et "), (F.col("n") - shown).cast("string"), F.lit(" autres")))
    title = F.concat(F.lit("Digest "), F.col("watch_title"))
    counted = F.concat(title, F.lit(" — "), F.col("n").cast("string"), F.lit(" annonce"), plural, F.lit(" active"), plural)
    return out.select(
        "watch", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        F.when(F.col("n") > 0, counted).otherwise(title).alias("title"),
        F.when(F.col("n") > 0, F.concat(F.col("body"), F.coalesce(more, F.lit(""))))
        .otherwise("Aucune annonce active retenue.").alias("message"))


def compare_settings(rows: DataFrame, current: DataFrame, draft: DataFrame) -> DataFrame:
    """What-if: the decision under two sets of watch settings, side by side, in one pass and without a sink."""
    from pricelens.operators.scoring import with_decision

    base = rows.columns
    first = with_decision(rows, current).select(*base, F.struct("keep", "tier").alias("now"))
    return with_decision(first, draft).select(
        *base, F.col("now.keep").alias("keep_now"), F.col("now.tier").alias("tier_now"),
        F.col("keep").alias("keep_draft"), F.col("tier").alias("tier_draft"))

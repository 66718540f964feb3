"""Hard-drive profile: vendor references against a catalogue, capacities, SMR/SAS rules, lots, usage hours.

Capacities are whole gigabytes. Everything is row-local: arrays and higher-order functions instead of exploding a
listing and regrouping it, so the classifier never shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.literals import let, lookup
from pricelens.functions.text import find_keyword, has_affirmed_keyword, has_keyword, strip_marks
from pricelens.operators.classify_keywords import RESULT_COLS, first_match, flag_array, with_text

HIT_DDL = "STRUCT<ref: STRING, family: STRING, brand: STRING, verdict: STRING, reason: STRING, cap: BIGINT>"
NEAR = 10  # capacities closer than this (GB) are equal


def _number(text: Column) -> Column:
    return text.try_cast("bigint")


class Catalogue:
    """Configured references as one literal map: its size is that of the configuration, not of the data."""

    ENTRY = "STRUCT<kind: STRING, family: STRING, brand: STRING, why: STRING>"

    def __init__(self, cfg: Mapping[str, Any]):
        self.entries: dict[str, dict[str, str]] = {}
        for reason, refs in (cfg.get("reject") or {}).items():
            for ref in refs or []:
                self.entries[ref.upper()] = {"kind": "reject", "why": str(reason)}
        for kind in ("low_tier", "accept"):
            for group in cfg.get(kind) or []:
                for ref in map(str.upper, group.get("refs") or []):
                    self.entries[ref] = {"kind": kind, "family": group["family"], "brand": group.get("brand") or None}

    def find(self, ref: Column) -> Column:
        return lookup(self.entries, ref, self.ENTRY)


def raw_references(upper: Column, vendor: str) -> Column:
    """References of one vendor as written, without the tolerated spaces and dashes, each once."""
    found = F.regexp_extract_all(upper, F.lit(fv.REFERENCE_PATTERNS[vendor]), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.translate(x, " -", "")))


def reference_capacity(ref: Column, vendor: str) -> Column:
    """Gigabytes encoded in a reference; null when the digits say nothing."""
    if vendor == "seagate":
        return _number(F.regexp_extract(ref, r"^ST(\d{4,5})[A-Z]{2}", 1))
    if vendor == "wd":
        digits = F.regexp_extract(ref, r"^WD(\d{2,4})[A-Z]{4}", 1)
        two = _number(F.substring(digits, 1, 2))
        one = _number(F.substring(digits, 1, 1))
        return F.when((F.length(digits) == 3) & (two >= 10), two).otherwise(one) * 1000
    if vendor == "hgst":
        named = _number(F.regexp_extract(ref, r"T(\d{1,2})T", 1))
        drive = _number(F.regexp_extract(ref, r"HU[HS]\d{4}(\d{2})", 1))
        return F.when(named.isNotNull(), named * 1000).when(drive >= 40, drive * 100).otherwise(drive * 1000)
    if vendor == "toshiba_mg":
        code = F.regexp_extract(ref, r"^M[GN]\d{2}[ASN][CD]A(\d{1,2}T|\d{3})", 1)
        return F.when(code.endswith("T"), _number(F.regexp_extract(code, r"(\d+)", 1)) * 1000).otherwise(_number(code) * 10)
    return _number(F.regexp_extract(ref, r"^HDW[A-Z]\d(\d)", 1)) * 1000


def _structural(ref: Column, vendor: str) -> tuple[str, Column, Column]:
    """(brand, family, reject or warning reason) that the letters of a reference outside the catalogue stand for."""
    if vendor in ("seagate", "wd"):
        classes = fv.SEAGATE_CLASSES if vendor == "seagate" else fv.WD_CLASSES
        letters = F.regexp_extract(ref, r"^(?:ST|WD)\d+([A-Z]{2,4})", 1)
        letters = F.substring(letters, 1, 2) if vendor == "seagate" else letters
        kind = lookup({k: v[1] for k, v in classes.items()}, letters)
        reason = F.when(kind.isin("smr", "low_tier"), kind).otherwise("ref_unverified")
        return "Seagate" if vendor == "seagate" else "WD", lookup({k: v[0] for k, v in classes.items()}, letters), reason
    if vendor == "hgst":
        kind = lookup(fv.HGST_INTERFACES, F.regexp_extract(ref, r"AL([ENS45])", 1))
        return "WD/HGST", F.lit("Ultrastar"), F.when(kind.isin("4kn", "sas", "sas_4kn"), kind).otherwise("ref_unverified")
    if vendor == "toshiba_mg":
        family = F.when(ref.startswith("MG"), "Toshiba MG").otherwise("Toshiba N300")
        suffix = F.regexp_extract(ref, r"^M[GN]\d{2}[ASN][CD]A(?:\d{1,2}T|\d{3})([A-Z0-9]{0,2})$", 1)
        reason = F.when(F.regexp_extract(ref, r"^M[GN]\d{2}([ASN])", 1) == "S", "sas").when(
            suffix.startswith("A"), "4kn").otherwise("ref_unverified")
        return "Toshiba", family, reason
    family = lookup(fv.HDW_FAMILIES, F.substring(ref, 1, 4))
    return "Toshiba", family, F.when(family == "Toshiba S300", "low_tier").otherwise("ref_unverified")


def _hit(found: Column, vendor: str) -> Column:
    """Verdict of one reference: the catalogue's word, else the structural one."""
    ref, entry = found["ref"], found["entry"]
    brand, family, reason = _structural(ref, vendor)
    listed = entry["kind"].isin("accept", "low_tier")
    bad = F.when(entry["kind"].isNotNull(), entry["kind"] == "reject").otherwise(
        reason.isin("smr", "sas", "4kn", "sas_4kn"))
    why = (F.when(entry["kind"] == "accept", F.lit(None).cast("string")).when(entry["kind"] == "low_tier", "low_tier")
           .when(entry["kind"] == "reject", entry["why"]).otherwise(reason))
    return F.struct(
        ref.alias("ref"), F.when(listed, entry["family"]).otherwise(family).alias("family"),
        F.when(listed, F.coalesce(entry["brand"], F.lit(brand))).otherwise(F.lit(brand)).alias("brand"),
        F.when(bad, "reject").otherwise("accept").alias("verdict"), why.alias("reason"),
        reference_capacity(ref, vendor).alias("cap")).cast(HIT_DDL)


def reference_hits(upper: Column, catalogue: Catalogue) -> Column:
    """Every reference of the text with its verdict, in vendor order, each once."""
    def of_vendor(vendor: str) -> Column:
        raw = raw_references(upper, vendor)
        if vendor == "toshiba_hdw":
            # This family is listed by its short form, or by its full form when only that one is known.
            raw = F.transform(raw, lambda r: F.when(
                catalogue.find(F.substring(r, 1, 7)).isNull() & catalogue.find(r).isNotNull(), r).otherwise(F.substring(r, 1, 7)))
        found = F.transform(raw, lambda r: F.struct(r.alias("ref"), catalogue.find(r).alias("entry")))
        return F.transform(found, lambda x: _hit(x, vendor))

    return F.array_distinct(F.concat(*[of_vendor(v) for v in fv.REFERENCE_PATTERNS]))


def best_reference(hits: Column) -> Column:
    """Preferred accepted reference: listed, then unverified, then low tier; the first one on ties."""
    ranked = F.transform(hits, lambda h, i: F.struct(
        F.when(h["reason"].isNull(), 0).when(h["reason"] != "low_tier", 1).otherwise(2).alias("rank"), i.alias("i"),
        h.alias("h")))
    return F.array_min(ranked)["h"]


def capacity_set(text: Column) -> Column:
    """Capacities quoted per item, in GB. A lot total quoted once does not count; the Exos family name is read only
    when nothing else is written."""
    def all_of(pattern: str, group: int, unit: int) -> Column:
        found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: x != "")
        return F.transform(found, lambda x: x.cast("bigint") * unit)

    def quoted(tb: Column) -> Column:
        gb = F.filter(all_of(fv.CAPACITY_GB, 1, 1), lambda c: c >= 100)
        totals = F.concat(all_of(fv.LOT_TOTAL, 1, 1000), all_of(fv.LOT_TOTAL, 2, 1000))
        once = F.filter(totals, lambda c: F.size(F.filter(tb, lambda x: x == c)) <= 1)
        return F.array_except(F.array_union(tb, gb), once)

    def or_named(caps: Column) -> Column:
        named = F.concat(all_of(fv.EXOS_NAME, 1, 1000), all_of(fv.EXOS_NAME, 3, 1000))
        return F.when(F.size(caps) > 0, caps).otherwise(F.array_distinct(named))

    caps = let(let(all_of(fv.CAPACITY_TB, 1, 1000), quoted), or_named)
    return F.filter(caps, lambda c: c.between(100, 30000))


def drive_lot_quantity(title: Column) -> Column:
    """Items in the lot: the first pattern whose number lies in 2..20, else 1."""
    # Patterns capture digits or nothing, so the cast behind the emptiness test cannot fail.
    tries = F.array(*[F.regexp_extract(title, p, 1) for p in fv.DRIVE_LOT_PATTERNS])
    found = F.get(F.filter(tries, lambda n: (n != "") & n.cast("bigint").between(2, 20)), F.lit(0)).cast("bigint")
    return F.when(title.rlike("[0-9]"), F.coalesce(found, F.lit(1).cast("bigint"))).otherwise(F.lit(1).cast("bigint"))


def usage_hours(text: Column) -> Column:
    """Largest plausible number of hours quoted."""
    found = F.concat(F.regexp_extract_all(text, F.lit(fv.USAGE_HOURS), F.lit(1)),
                     F.regexp_extract_all(text, F.lit(fv.POWER_ON_HOURS), F.lit(1)))
    numbers = F.transform(found, lambda x: F.translate(x, " .", "").try_cast("bigint"))
    return F.array_max(F.filter(numbers, lambda n: n.between(100, 120000)))


def family_hint(text: Column) -> Column:
    """First family hint: struct(family, brand, low), null without one."""
    out = None
    for pattern, family, brand, low in fv.FAMILY_HINTS:
        value = F.struct(F.lit(family).alias("family"), F.lit(brand).alias("brand"), F.lit(low).alias("low"))
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def brand_hint(text: Column) -> Column:
    return first_match([(text.rlike(p), b) for p, b in fv.BRAND_HINTS])


def capacity_reason(caps: Column, quoted_total: Column, qty: Column, chosen: Column, chosen_cap: Column, target: int,
                    title: Column) -> tuple[Column, Column]:
    """(reject reason, several capacities quoted) from the capacities of one listing."""
    def near(c: Column, value: Column | int) -> Column:
        return F.abs(c - value) < NEAR

    lot_sum = (qty > 1) & quoted_total & ~F.exists(caps, lambda c: near(c, target))
    full = F.when(chosen_cap > 0, F.array_union(caps, F.array(chosen_cap))).otherwise(caps)
    others = F.filter(full, lambda c: ~near(c, target))
    competing = F.filter(others, lambda c: ~((qty > 1) & near(c, qty * target)))
    some = F.size(full) > 0
    reason = (
        F.when(lot_sum, "capacity_mismatch")
        .when(title.rlike(fv.COMMA_LIST) | title.rlike(fv.GENERIC_OFFER), "generic")
        .when(~some & ~chosen, "no_capacity")
        .when(some & ~F.array_contains(full, F.lit(target).cast("bigint")) & ~chosen, "capacity_mismatch")
        .when((qty > 1) & F.exists(others, lambda c: near(c * qty, target)), "capacity_mismatch")
        .when(F.size(competing) >= 2, "generic")
    )
    return reason, F.size(competing) == 1


def classify_drives(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    inner = df.columns
    target = int(round(float(cfg.get("target_capacity_tb", 8)) * 1000))
    words = {**fv.DRIVE_KEYWORDS, **(cfg.get("keywords") or {})}
    catalogue = Catalogue(cfg.get("models") or {})
    df = with_text(df)
    t, d, full = F.col("t"), F.col("d"), F.col("full")

    # 1. what the text alone rules out
    early = (
        F.when((F.col("condition_code") == "parts") | has_affirmed_keyword(full, words["dead"]), "dead")
        .when(t.rlike(fv.DRIVE_SSD) & ~t.rlike(r"\bhdd\b"), "ssd")
        .when(has_keyword(t, words["external"]), "external")
        .when(t.rlike(fv.SMALL_FORM), "2.5in")
        .when(has_keyword(t, words["bundle"]) | t.rlike(fv.NAS_MODEL), "nas_bundle")
        .when(has_keyword(t, words["other_device"]), "other_device")
    )
    upper = F.upper(strip_marks(F.concat_ws("\n", "title", F.coalesce("description", F.lit("")))))
    none = F.array().cast(f"array<{HIT_DDL}>")
    df = df.withColumns({"early": early, "upper": upper})
    df = df.withColumn("hits", F.when(F.col("early").isNull(), reference_hits(F.col("upper"), catalogue)).otherwise(none))

    open_row = F.col("early").isNull()

    # 2. references, those of the target capacity first
    fits = F.filter("hits", lambda h: h["cap"].isNull() | (F.abs(h["cap"] - target) < NEAR))
    df = df.withColumns({
        "chosen": best_reference(F.filter(fits, lambda h: h["verdict"] == "accept")),
        "bad": F.get(F.filter(fits, lambda h: h["verdict"] == "reject"), F.lit(0)),
        "any_bad": F.get(F.filter("hits", lambda h: h["verdict"] == "reject"), F.lit(0)),
        "any_hit": F.get("hits", F.lit(0)),
        "caps": F.when(open_row, capacity_set(full)), "qty": F.when(open_row, drive_lot_quantity(t)),
    })
    chosen = F.col("chosen").isNotNull()
    df = df.withColumn("aside", F.when(~chosen, F.coalesce("bad", "any_bad", "any_hit")))
    title_fits = F.exists(capacity_set(t), lambda c: F.abs(c - target) < NEAR)
    by_reference = F.when(
        ~chosen & F.col("any_hit").isNotNull(),
        F.when(F.col("bad").isNotNull() | F.col("any_bad").isNotNull(), F.coalesce(F.col("aside.reason"), F.lit("rejected_ref")))
        .when(~title_fits, "capacity_mismatch"))

    # 3. interface and recording words
    listed = chosen & F.col("chosen.reason").isNull()
    smr = find_keyword(t, words["smr"])
    by_words = F.when(has_keyword(t, words["sas"]) | (has_keyword(d, words["sas"]) & ~listed), "sas").when(
        smr.isNotNull() & ~((smr == "smr") & t.rlike(r"\bcmr\b")), "smr")

    # 4. capacities
    by_capacity, several = capacity_reason(F.col("caps"), t.rlike(fv.LOT_TOTAL), F.col("qty"), chosen,
                                           F.coalesce(F.col("chosen.cap"), F.lit(0)), target, t)
    df = df.withColumns({"ref_reason": by_reference, "word_reason": by_words, "cap_reason": by_capacity, "several": several,
                         "hint": F.when(open_row, family_hint(full))})
    df = df.withColumn("reason", F.coalesce("early", "ref_reason", "word_reason", "cap_reason"))

    # 5. family, lot, hours
    accepted = F.col("reason").isNull()
    lot = F.col("qty") > 1
    hinted = F.col("hint").isNotNull()
    aside = F.when(F.col("early").isNull(), F.col("aside"))
    flags = flag_array(
        F.when(F.col("several"), "multi_capacity"),
        F.when(chosen, F.col("chosen.reason")).when(hinted, "ref_missing").otherwise("model_unknown"),
        F.when(~chosen & hinted & F.col("hint.low"), "low_tier"),
        F.when(lot | t.rlike(r"\blot\b"), "lot"))

    def named(part: str, hint: Column) -> Column:
        return F.when(accepted & chosen, F.col(f"chosen.{part}")).when(accepted, F.coalesce(hint, aside[part])).otherwise(aside[part])

    # What a rejected row still tells: the capacities that decided against it.
    hit_caps = F.array_distinct(F.filter(F.transform("hits", lambda h: h["cap"]), lambda c: c > 0))
    elsewhere = F.col("early").isNull() & ~chosen & F.col("bad").isNull() & F.col("any_hit").isNotNull()
    counted = (F.coalesce("early", "ref_reason", "word_reason").isNull() & F.col("cap_reason").isin("capacity_mismatch", "generic")
               & ~(t.rlike(fv.COMMA_LIST) | t.rlike(fv.GENERIC_OFFER))
               & ~((F.col("qty") > 1) & t.rlike(fv.LOT_TOTAL) & ~F.exists("caps", lambda c: F.abs(c - target) < NEAR)))
    all_caps = F.when(chosen & (F.col("chosen.cap") > 0), F.array_union("caps", F.array("chosen.cap"))).otherwise(F.col("caps"))
    attrs = F.map_filter(F.create_map(
        F.lit("capacities_gb"), F.array_join(F.transform(F.sort_array(all_caps), lambda c: c.cast("string")), ", "),
        F.lit("smart_hours"), usage_hours(full).cast("string")), lambda k, v: v.isNotNull() & (v != ""))
    turned_down = F.when(counted, all_caps).when(elsewhere, hit_caps)
    only_caps = F.map_filter(F.create_map(F.lit("capacities_gb"), F.array_join(F.transform(F.sort_array(turned_down), lambda c: c.cast("string")), ", ")),
                             lambda k, v: v.isNotNull() & (v != ""))
    return df.select(
        *[c for c in inner if c not in RESULT_COLS],
        F.when(accepted, "accept").otherwise("reject").alias("verdict"), "reason",
        named("family", F.col("hint.family")).alias("family"),
        F.when(accepted & chosen, F.col("chosen.ref")).otherwise(aside["ref"]).alias("model"),
        named("brand", F.coalesce(F.col("hint.brand"), brand_hint(full))).alias("brand"),
        F.when(accepted, flags).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.when(accepted, attrs).otherwise(only_caps).alias("attrs"),
        F.when(accepted & lot, F.col("qty")).otherwise(F.lit(1).cast("bigint")).alias("quantity"))

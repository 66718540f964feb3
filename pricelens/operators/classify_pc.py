"""PC profile: a performance floor instead of an exact reference.

A CPU is reduced to generation + tier bonus; RAM and storage are read in GB. The chassis is the family and the
CPU the model. All of it is row-local array work.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.literals import let, lookup
from pricelens.functions.text import (find_affirmed_keyword, find_keyword, has_keyword, keyword_pattern, normalize_text, normalized)
from pricelens.operators.classify_keywords import RESULT_COLS, family_case, flag_array, with_text

CPU_DDL = "STRUCT<label: STRING, tier: STRING, gen: BIGINT, score: BIGINT>"


def _bare(pattern: str) -> str:
    """The pattern without its outer look-arounds, for text that is already a match."""
    return re.sub(r"\(\?<?!\[[^\]]*\]\)", "", pattern)


def _cpu(label: Column, tier: Column, gen: Column) -> Column:
    points = lookup(fv.CPU_TIER_POINTS, tier, "BIGINT")
    return F.struct(label.alias("label"), tier.alias("tier"), gen.alias("gen"), (gen + points).alias("score")).cast(CPU_DDL)


def cpu_list(text: Column) -> Column:
    """Every CPU quoted in a normalised text: numbered Intel, Intel by generation, Ryzen, low-end, bare tier."""
    def matches(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def part(x: Column, pattern: str, group: int) -> Column:
        return F.regexp_extract(x, _bare(pattern), group)

    def intel(x: Column) -> Column:
        number = part(x, fv.CPU_INTEL, 2)
        gen = F.when(F.length(number) == 5, F.substring(number, 1, 2)).otherwise(F.substring(number, 1, 1)).cast("bigint")
        tier = part(x, fv.CPU_INTEL, 1)
        return _cpu(F.concat(F.lit("i"), tier, F.lit("-"), number, F.upper(part(x, fv.CPU_INTEL, 3))), tier, gen)

    def by_generation(x: Column) -> Column:
        tier, gen = part(x, fv.CPU_INTEL_GEN, 1), part(x, fv.CPU_INTEL_GEN, 2).try_cast("bigint")
        return _cpu(F.concat(F.lit("i"), tier, F.lit(" "), gen.cast("string"), F.lit("e gén.")), tier, gen)

    def ryzen(x: Column) -> Column:
        tier, number = part(x, fv.CPU_RYZEN, 1), part(x, fv.CPU_RYZEN, 3)
        gen = lookup(fv.RYZEN_GENERATIONS, F.substring(number, 1, 1), "BIGINT")
        pro = F.when(part(x, fv.CPU_RYZEN, 2) != "", " PRO").otherwise("")
        return _cpu(F.concat(F.lit("Ryzen "), tier, pro, F.lit(" "), number, F.upper(part(x, fv.CPU_RYZEN, 4))), tier, gen)

    no_gen = F.lit(None).cast("bigint")
    numbered = F.transform(matches(fv.CPU_INTEL), intel)
    generation = F.filter(F.transform(matches(fv.CPU_INTEL_GEN), by_generation), lambda c: c["gen"].between(2, 20))
    amd = F.transform(matches(fv.CPU_RYZEN), ryzen)
    low = F.transform(matches(fv.CPU_LOW_END), lambda x: _cpu(F.initcap(x), x, no_gen))
    bare = F.transform(F.regexp_extract_all(text, F.lit(fv.CPU_BARE_TIER), F.lit(1)),
                       lambda x: _cpu(F.concat(F.lit("i"), x), x, no_gen))
    return F.concat(numbered, generation, amd, low, bare)


def best_cpu(cpus: Column) -> Column:
    """The highest score, the first one on ties; without any score, the first CPU; null without a CPU."""
    ranked = F.transform(cpus, lambda c, i: F.struct((-c["score"]).alias("s"), i.alias("i"), c.alias("c")))
    scored = F.array_min(F.filter(ranked, lambda r: r["s"].isNotNull()))["c"]
    return F.coalesce(scored, F.get(cpus, F.lit(0)))


def memory(text: Column) -> Column:
    """struct(ram, storage, kind) of a normalised text, in GB.

    The text is split at its GB amounts: the piece before an amount and the piece after it are that amount's
    context. A piece is cut at the nearest TB amount or separator, and the closer context word wins; on a tie, or
    without any word, the amount itself decides.
    """
    amounts = F.regexp_extract_all(text, F.lit(fv.MEMORY_GB), F.lit(1))
    pieces = F.split(text, fv.MEMORY_GB, -1)

    def before_words(piece: Column) -> Column:
        return F.regexp_replace(F.substring(piece, -22, 22), f"^.*(?:{fv.MEMORY_TB}|{fv.CONTEXT_BREAK})", "")

    def after_words(piece: Column) -> Column:
        return F.regexp_replace(F.substring(piece, 1, 14), f"(?:[0-9]|{fv.CONTEXT_BREAK}).*$", "")

    far = F.lit(1000)

    def distance(pattern: str, context: Column) -> Column:
        back = F.when(context["before"].rlike(pattern),
                      F.length(F.regexp_replace(context["before"], f"^.*(?:{pattern})", "")))
        ahead = F.regexp_instr(context["after"], F.lit(f"({pattern})"))
        return F.least(back, F.when(ahead > 0, ahead - 1), far)

    def place(amount: Column, i: Column) -> Column:
        context = F.struct(before_words(F.get(pieces, i)).alias("before"), after_words(F.get(pieces, i + 1)).alias("after"))
        near = let(context, lambda c: F.struct(distance(fv.RAM_WORDS, c).alias("ram"), distance(fv.STORAGE_WORDS, c).alias("sto")))
        gb = amount.cast("bigint")
        return let(near, lambda n: F.struct(
            gb.alias("gb"),
            F.when(n["ram"] < n["sto"], "ram").when(n["sto"] < n["ram"], "sto").when(n["ram"] == far, "any")
            .when(gb <= 64, "ram").otherwise("sto").alias("kind")))

    def summary(placed: Column) -> Column:
        def largest(keep) -> Column:
            return F.array_max(F.transform(F.filter(placed, keep), lambda p: p["gb"]))

        # Without a named RAM amount, the first small amount without context is the RAM.
        ram_any = F.get(F.filter(placed, lambda p: (p["kind"] == "any") & (p["gb"] <= 64)), F.lit(0))["gb"]
        tb = F.transform(F.regexp_extract_all(text, F.lit(fv.MEMORY_TB), F.lit(1)), lambda x: x.cast("bigint") * 1000)
        storage = F.greatest(
            largest(lambda p: (p["kind"] == "sto") | ((p["kind"] == "any") & (p["gb"] >= 120))), F.array_max(tb))
        kind = F.when(text.rlike(fv.KIND_NVME), "SSD NVMe").when(text.rlike(fv.KIND_SSD), "SSD").when(
            text.rlike(fv.KIND_HDD), "HDD").otherwise("")
        ram = F.coalesce(largest(lambda p: p["kind"] == "ram"), ram_any)
        return F.struct(ram.alias("ram"), storage.alias("storage"), kind.alias("kind"))

    return let(F.transform(amounts, place), summary)


def memory_extract(df: DataFrame, column: str = "full") -> DataFrame:
    return df.withColumn("memory", memory(F.col(column)))


def form_factor_reject(title: Column, rejected: list[str], mini: list[str]) -> Column:
    """The rejected form word, unless a mini word is left once all rejected words are blanked out."""
    pattern = keyword_pattern(rejected)
    if not pattern:
        return F.lit(None).cast("string")
    left = F.regexp_replace(title, pattern, " ")
    return F.when(~has_keyword(left, mini), find_keyword(title, rejected))


def pc_lot_quantity(title: Column) -> Column:
    """The first lot pattern found decides; its number counts only within 2..50."""
    tries = F.array(*[F.regexp_extract(title, p, 1) for p in fv.PC_LOT_PATTERNS])
    first = F.get(F.filter(tries, lambda n: n != ""), F.lit(0)).cast("bigint")
    number = let(first, lambda n: F.when(n.between(2, 50), n))
    return F.coalesce(F.when(title.rlike("[0-9]"), number), F.lit(1).cast("bigint"))


def cpu_floor(cpu: str | None) -> int | None:
    """Score of the configured floor ('i5-8400', 'i5 8e gen', 'Ryzen 5 4650GE'), by the patterns that read the listings.

    A floor that names no scored CPU is an error: listings would pass it unseen."""
    text = normalized(cpu or "")
    if not text:
        return None
    scores = []
    for m in re.finditer(fv.CPU_INTEL, text):
        scores.append(int(m.group(2)[:2] if len(m.group(2)) == 5 else m.group(2)[0]) + fv.CPU_TIER_POINTS[m.group(1)])
    for m in re.finditer(fv.CPU_INTEL_GEN, text):
        if 2 <= int(m.group(2)) <= 20:
            scores.append(int(m.group(2)) + fv.CPU_TIER_POINTS[m.group(1)])
    for m in re.finditer(fv.CPU_RYZEN, text):
        if m.group(3)[0] in fv.RYZEN_GENERATIONS:
            scores.append(fv.RYZEN_GENERATIONS[m.group(3)[0]] + fv.CPU_TIER_POINTS[m.group(1)])
    if not scores:
        raise ValueError(f"min_cpu {cpu!r} names no CPU with a known generation")
    return max(scores)


def classify_pc(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    inner = df.columns
    floor, ram_floor, sto_floor = cpu_floor(cfg.get("min_cpu")), int(cfg.get("min_ram_gb") or 0), int(cfg.get("min_storage_gb") or 0)
    families = list(cfg.get("families") or [])
    reject = cfg["reject"] if cfg.get("reject") is not None else fv.DRIVE_KEYWORDS["dead"]
    df = with_text(df)
    t, d, full = F.col("t"), F.col("d"), F.col("full")

    word = F.coalesce(find_keyword(t, cfg.get("reject_title") or []), find_affirmed_keyword(full, reject))
    form = form_factor_reject(t, cfg.get("reject_form") or [], cfg.get("mini_any") or fv.PC_MINI_WORDS)
    df = df.withColumns({"word": word, "form": form,
                         "fam": family_case(families, lambda w: has_keyword(t, w) | has_keyword(d, w))})
    fam_null = F.col("fam").isNull()
    early = (
        F.when(F.col("condition_code") == "parts", "dead")
        .when(F.col("word").isNotNull(), F.concat(F.lit("reject:"), F.col("word")))
        .when(t.rlike(fv.WANTED_AD), "wanted")
        .when(F.col("form").isNotNull(), F.concat(F.lit("form:"), F.col("form")))
    )
    no_family = F.when(fam_null, "family_unknown") if cfg.get("require_family") else F.when(fam_null & t.rlike(fv.CPU_ALONE), "cpu_only")
    family_gen = lookup({str(f["name"]): int(f["gen"]) for f in families if f.get("gen")}, F.col("fam"), "BIGINT")
    df = df.withColumns({"early": early, "raw_cpu": F.coalesce(best_cpu(cpu_list(t)), best_cpu(cpu_list(d))), "fam_gen": family_gen})

    # A bare tier takes the generation of its chassis; without chassis nor generation it identifies nothing.
    bare = F.col("raw_cpu.gen").isNull() & F.col("raw_cpu.tier").isin("3", "5", "7", "9")
    assumed = bare & F.col("fam_gen").isNotNull()
    label = F.concat(F.col("raw_cpu.label"), F.lit(" ("), F.col("fam_gen").cast("string"), F.lit("e gén.)"))
    df = df.withColumn("cpu", F.when(assumed, _cpu(label, F.col("raw_cpu.tier"), F.col("fam_gen"))).when(bare & fam_null, None)
                       .otherwise(F.col("raw_cpu"))).withColumn("assumed", F.coalesce(assumed, F.lit(False)))
    score = F.col("cpu.score")
    below = F.lit(False) if floor is None else F.when(score.isNotNull(), score < floor).otherwise(
        F.coalesce(F.col("cpu.tier").isin("celeron", "pentium", "athlon"), F.lit(False)))
    df = df.withColumns({"mem": memory(full), "pcs": pc_lot_quantity(t)})
    barebone = full.rlike(fv.BAREBONE)
    no_ram, no_sto = barebone | full.rlike(fv.NO_RAM), barebone | full.rlike(fv.NO_STORAGE)
    ram = F.when(~no_ram, F.col("mem.ram"))
    sto = F.when(~no_sto, F.col("mem.storage"))
    df = df.withColumns({"ram_gb": ram, "sto_gb": sto, "barebone": barebone, "no_ram": no_ram, "no_sto": no_sto, "below": below})
    ram_below = (F.lit(ram_floor) > 0) & (F.col("ram_gb") < ram_floor)
    sto_below = (F.lit(sto_floor) > 0) & (F.col("sto_gb") < sto_floor)
    # How far the checks went: a rejected row keeps the flags and attributes found up to there.
    stage = (F.when(F.coalesce("early", no_family).isNotNull(), 0).when(F.col("below"), 1).when(fam_null & F.col("cpu").isNull(), 2)
             .when(ram_below, 3).when(sto_below, 4).otherwise(5))
    late = (
        F.when(F.col("stage") == 1, F.concat(F.lit("cpu_below:"), F.col("cpu.label")))
        .when(F.col("stage") == 2, "no_match")
        .when(F.col("stage") == 3, F.concat(F.lit("ram_below:"), F.col("ram_gb").cast("string")))
        .when(F.col("stage") == 4, F.concat(F.lit("storage_below:"), F.col("sto_gb").cast("string")))
    )
    df = df.withColumns({"shape": F.coalesce("early", no_family), "stage": stage}).withColumn("reason", F.coalesce("shape", late))
    accepted, reached, named = F.col("reason").isNull(), F.col("shape").isNull(), F.col("early").isNull()

    def after(least: int, value: Column) -> Column:
        return F.when(F.col("stage") >= least, value)

    flags = flag_array(
        after(1, F.when(fam_null, "family_unknown")),
        after(1, F.when(t.rlike(fv.SCREEN_BUNDLE), "bundle")),
        after(1, F.when(F.col("assumed"), "cpu_gen_assumed")),
        after(2, F.when(score.isNull(), "cpu_unknown")),
        after(3, F.when(F.col("barebone"), "barebone").when(F.col("no_ram"), "no_ram")),
        after(3, F.when(~F.col("barebone") & F.col("no_sto"), "no_storage")),
        after(3, F.when(full.rlike(fv.NO_PSU), "no_psu")),
        after(4, F.when(~F.col("no_ram") & F.col("ram_gb").isNull(), "ram_unknown")),
        after(5, F.when(~F.col("no_sto") & F.col("sto_gb").isNull(), "storage_unknown")),
        after(5, F.when(F.col("pcs") > 1, "lot")))
    attrs = F.map_filter(F.create_map(
        F.lit("cpu"), after(1, F.col("cpu.label")), F.lit("cpu_score"), after(1, score.cast("string")),
        F.lit("cpu_gen"), after(1, F.when(score.isNotNull(), F.col("cpu.gen").cast("string"))),
        F.lit("ram_gb"), after(3, F.col("ram_gb").cast("string")), F.lit("storage_gb"), after(4, F.col("sto_gb").cast("string")),
        F.lit("storage"), after(4, F.when(F.col("sto_gb").isNotNull(), F.col("mem.kind")))), lambda k, v: v.isNotNull() & (v != ""))
    return df.select(
        *[c for c in inner if c not in RESULT_COLS],
        F.when(accepted, "accept").otherwise("reject").alias("verdict"), "reason",
        F.when(named, F.col("fam")).alias("family"), F.when(reached, F.col("cpu.label")).alias("model"),
        F.lit(None).cast("string").alias("brand"),
        flags.alias("flags"), attrs.alias("attrs"),
        F.when(accepted, F.col("pcs")).otherwise(F.lit(1).cast("bigint")).alias("quantity"))


__all__ = ["classify_pc", "cpu_list", "best_cpu", "memory", "memory_extract", "form_factor_reject", "pc_lot_quantity", "normalize_text"]

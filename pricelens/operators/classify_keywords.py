"""Keyword profile: required and forbidden words, families, optional reference pattern, lots."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.functions.text import find_keyword, has_keyword, keyword_pattern, normalize_text

# Columns every classifier adds to its input.
RESULT_COLS = ["verdict", "reason", "family", "model", "brand", "flags", "attrs", "quantity"]


def with_text(df: DataFrame) -> DataFrame:
    """Normalised title, description and both together."""
    return df.withColumns({"t": normalize_text(F.col("title")), "d": normalize_text(F.col("description"))}).withColumn(
        "full", F.trim(F.concat_ws(" ", "t", "d")))


def first_match(text_tests: list[tuple[Column, str]]) -> Column:
    """Value of the first test that holds, in order; null when none does."""
    out = None
    for test, value in text_tests:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if out is not None else F.lit(None).cast("string")


def lot_number(text: Column, pattern: str) -> Column:
    """Number captured by a lot pattern; null when absent."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.try_cast("bigint"))


def flag_array(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


def family_case(families: list[Mapping[str, Any]], test) -> Column:
    """First family with a matching word. One alternation over all words is tried before the ordered cascade."""
    if not families:
        return F.lit(None).cast("string")
    anything = [w for f in families for w in f.get("any") or []]
    cascade = first_match([(test(f.get("any") or []), str(f["name"])) for f in families if f.get("any")])
    return F.when(test(anything), cascade)


def _judged(df: DataFrame, hit: Column, required: Column, family: Column, model: Column, lot_n: Column, strict: Column, flagged: Column) -> DataFrame:
    """The profile's verdict over texts of ``with_text``, from what the words of a watch say about them."""
    df = df.withColumns({"hit": hit, "fam": family, "mod": model, "lot_n": lot_n})
    early = (
        F.when(F.col("condition_code") == "parts", "dead")
        .when(F.col("hit").isNotNull(), F.concat(F.lit("reject:"), F.col("hit")))
        .when(~required, "no_match")
    )
    df = df.withColumn("early", early)
    df = df.withColumn("reason", F.coalesce("early", F.when(strict & F.col("fam").isNull(), "family_unknown")))
    accepted, reached = F.col("reason").isNull(), F.col("early").isNull()
    lot = F.col("lot_n").between(2, 50)
    flags = flag_array(
        F.when(flagged & F.col("fam").isNull(), "family_unknown"),
        F.when(F.col("fam").isNull() & F.col("mod").isNull(), "model_unknown"),
        F.when(lot, "lot"))
    return df.withColumns({
        "verdict": F.when(accepted, "accept").otherwise("reject"), "family": F.when(reached, F.col("fam")), "model": F.when(reached, F.col("mod")),
        "brand": F.lit(None).cast("string"), "flags": F.when(accepted, flags).otherwise(F.array().cast("array<string>")),
        "attrs": F.create_map().cast("map<string,string>"),
        "quantity": F.when(accepted & lot, F.col("lot_n")).otherwise(F.lit(1)).cast("bigint")})


def _family_mode(cfg: Mapping[str, Any]) -> tuple[bool, bool]:
    """(a family is required, a missing one is flagged)."""
    mode = str(cfg.get("require_family", False)).lower()
    return mode not in ("false", "flag", "none", ""), mode == "flag"


def classify_keywords(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    inner = [c for c in df.columns if c not in RESULT_COLS]
    df = with_text(df.select(*inner))
    t, full = F.col("t"), F.col("full")
    hit = F.coalesce(find_keyword(t, cfg.get("reject_title") or []), find_keyword(full, cfg.get("reject") or []))
    required = has_keyword(full, cfg["require_any"]) if cfg.get("require_any") else F.lit(True)
    model = F.lit(None).cast("string")
    if cfg.get("model_regex"):
        pattern = f"(?i)({cfg['model_regex']})"
        found = F.coalesce(*[F.when(F.col(c).rlike(pattern), F.trim(F.regexp_extract(c, pattern, 1)))
                             for c in ("title", "description")])
        model = F.when(found != "", found)
    strict, flagged = _family_mode(cfg)
    out = _judged(df, hit, required, family_case(list(cfg.get("families") or []), lambda w: has_keyword(full, w)), model,
                  lot_number(t, cfg.get("lot_regex") or fv.KEYWORDS_LOT), F.lit(strict), F.lit(flagged))
    return out.select(*inner, *RESULT_COLS)


SETTINGS_DDL = ("watch string, settings struct<reject_title: string, reject: string, required: string, families: array<struct<name: string, words: string>>, "
                "any_family: string, model: string, lot: string, strict: boolean, flagged: boolean>")


def keyword_settings(df: DataFrame, configs: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(watch, settings): the words of each watch as patterns, one row per watch; null where a watch has none."""
    def captured(words: Any) -> str | None:
        pattern = keyword_pattern(words or [])
        return f"({pattern})" if pattern else None

    def settings(cfg: Mapping[str, Any]) -> tuple:
        families = [f for f in cfg.get("families") or [] if f.get("any")]
        return (captured(cfg.get("reject_title")), captured(cfg.get("reject")), captured(cfg.get("require_any")),
                [(str(f["name"]), captured(f["any"])) for f in families], captured([w for f in families for w in f["any"]]),
                f"(?i)({cfg['model_regex']})" if cfg.get("model_regex") else None, cfg.get("lot_regex") or fv.KEYWORDS_LOT, *_family_mode(cfg))

    return df.sparkSession.createDataFrame([(name, settings(cfg)) for name, cfg in configs.items()], SETTINGS_DDL)


def classify_keywords_of_watches(df: DataFrame, configs: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Rows of all these watches in one pass: each row is matched with the patterns of its own watch.

    Verdicts are those of ``classify_keywords`` watch by watch. Settings are rows of a small frame that is joined by watch, so neither the
    plan nor the reads grow with the number of watches; rows of other watches and of none are left out. Spark keeps the last pattern of
    an expression compiled, so rows that lie together by watch compile each pattern once.
    """
    inner = [c for c in df.columns if c not in RESULT_COLS]
    rows = df.select(*inner, F.col("watch").alias("_of")).join(
        keyword_settings(df, configs).select(F.col("watch").alias("_owner"), F.col("settings").alias("_set")), F.col("_of") == F.col("_owner"))
    rows = with_text(rows)
    t, full = F.col("t"), F.col("full")

    def group(text: Column, pattern: Column) -> Column:
        return F.call_function("regexp_extract", text, pattern, F.lit(1))

    def found(text: Column, pattern: Column) -> Column:
        word = group(text, pattern)
        return F.when(word != "", word)

    own = {name: F.col(f"_set.{name}") for name in ("reject_title", "reject", "required", "families", "any_family", "model", "lot", "strict", "flagged")}
    family = F.when(found(full, own["any_family"]).isNotNull(),
                    F.get(F.filter(own["families"], lambda f: group(full, f["words"]) != ""), F.lit(0))["name"])
    named = F.coalesce(*[F.when(F.regexp_instr(F.col(c), own["model"]) > 0, F.trim(group(F.col(c), own["model"]))) for c in ("title", "description")])
    lot = group(t, own["lot"])
    out = _judged(rows, F.coalesce(found(t, own["reject_title"]), found(full, own["reject"])),
                  own["required"].isNull() | found(full, own["required"]).isNotNull(), family, F.when(named != "", named),
                  F.when(lot != "", lot.try_cast("bigint")), own["strict"], own["flagged"])
    return out.select(*inner, *RESULT_COLS)


__all__ = ["classify_keywords", "classify_keywords_of_watches", "with_text", "first_match", "lot_number", "flag_array", "family_case", "keyword_pattern"]

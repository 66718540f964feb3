"""Watches of the keyword profile in one pass: verdicts as watch by watch, one read whatever their number."""

import pytest
from pyspark.sql import functions as F

from pricelens.operators.classify_keywords import RESULT_COLS, classify_keywords, classify_keywords_of_watches
from pricelens.operators.profiles import classify_by_watch
from pricelens.plans.title_cases import KW_CASES, KW_CFG

CONFIGS = {
    "card": KW_CFG,
    "strict": {**KW_CFG, "require_family": True, "reject_title": []},
    "plain": {"reject": ["hs"], "lot_regex": r"x(\d+)"},
    "empty": {},
    "odd": {"require_any": ["c++", "3080 (oc)"], "families": [{"name": "none", "any": []}, {"name": "plus", "any": ["c++"]}], "model_regex": "z*"},
}
TEXTS = [c[:2] for c in KW_CASES] + [("", ""), (None, None), ("c++ livre", None), ("3080 (oc) x12", "zz"), ("lot x3", "HS"), ("x99999999999999999999", ""),
                                    ("carte 3080 " * 300, "rtx 3080 " * 300)]
FIELDS = "id bigint, watch string, title string, description string, condition_code string, verdict string"


def rows(spark):
    texts = [(title, text and text.replace("{q}", "7")) for title, text in TEXTS]
    out = [(w, title and title.replace("{q}", "7"), text, condition) for w in CONFIGS for title, text in texts for condition in ("used", "parts", None)]
    return spark.createDataFrame([(i, *r, "old") for i, r in enumerate(out)], FIELDS)


def told(df):
    return sorted(tuple(r) for r in df.select("id", "watch", *[F.to_json(F.struct(c)).alias(c) for c in RESULT_COLS]).collect())


def test_verdicts_are_those_of_each_watch_alone(spark):
    df = rows(spark)
    alone = [r for name, cfg in CONFIGS.items() for r in told(classify_keywords(df.where(F.col("watch") == name), cfg))]
    together = classify_keywords_of_watches(df, CONFIGS)
    assert told(together) == sorted(alone)
    assert together.columns == classify_keywords(df, KW_CFG).columns


def test_rows_of_other_watches_and_of_none_are_left_out(spark):
    df = spark.createDataFrame([(1, "card", "RTX 3080", "", None, None), (2, "other", "RTX 3080", "", None, None), (3, None, "RTX 3080", "", None, None)], FIELDS)
    assert [r.id for r in classify_keywords_of_watches(df, CONFIGS).collect()] == [1]
    assert classify_keywords_of_watches(df.where("false"), CONFIGS).count() == 0
    repeated = classify_keywords_of_watches(df.unionAll(df), CONFIGS).collect()
    assert [(r.id, r.verdict) for r in repeated] == [(1, "accept"), (1, "accept")]


@pytest.mark.parametrize("number", [2, 40])
def test_reads_do_not_grow_with_the_number_of_watches(spark, tmp_path, number):
    path = str(tmp_path / "rows")
    rows(spark).write.parquet(path)
    watches = {f"w{i}": {"watch": f"w{i}", "profile": {"type": "keywords", "keywords": {"require_any": [f"word{i}"]}}} for i in range(number)}
    plan = classify_by_watch(spark.read.parquet(path), watches)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan

"""Tiers, filters, notes and scam rules on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from pricelens.config import resolve_watches, watch_frame
from pricelens.operators.profiles import PROFILES
from pricelens.operators.scoring import score

RAW = {
    "thresholds": [{"max_cents": 30000, "priority": "low"}, {"max_cents": 20000, "priority": "urgent", "tags": ["fire"]}],
    "market": {"reference_cents": 24000, "min_unit_cents": 5000}, "notify": {"max_age_days": 100},
    "watches": {"w": {"profile": {"type": "hdd"}}, "strict": {"notify": {"require_delivery": True}, "profile": {"type": "keywords"}},
                "off": {"enabled": False}},
}
DDL = ("id int, watch string, price_cents bigint, shipping_cents bigint, shipping_estimated boolean, fees_cents bigint, quantity bigint, "
       "flags array<string>, verdict string, posted_at string, delivery boolean, secure_payment boolean, seller_reviews bigint")


def run(spark, *rows):
    base = dict(watch="w", price_cents=18000, shipping_cents=0, shipping_estimated=False, fees_cents=0, quantity=1, flags=[], verdict="accept",
                posted_at="2026-01-01 00:00:00", delivery=True, secure_payment=True, seller_reviews=9)
    names = [c.split()[0] for c in DDL.split(", ")]
    data = [tuple({**base, **r, "id": i}[n] for n in names) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, DDL).withColumn("seen_at", F.lit("2026-02-01").cast("timestamp"))
    return score(df, watch_frame(spark, resolve_watches(RAW), PROFILES)).orderBy("id").collect()


def test_tier_bounds_are_inclusive_and_sorted(spark):
    out = run(spark, {"price_cents": 20000}, {"price_cents": 20001}, {"price_cents": 30001}, {"verdict": "reject"})
    assert [(r.tier, r.priority, r.keep) for r in out] == [
        ("urgent", "urgent", True), ("low", "low", True), ("ignore", "none", False), ("reject", "none", False)]
    assert out[0].tags == ["fire"] and out[2].tags == []


def test_lots_and_per_unit(spark):
    out = run(spark, {"price_cents": 40000, "quantity": 2, "flags": ["lot"]},
              {"price_cents": 40000, "quantity": 2, "flags": ["multi_capacity", "lot"]}, {"price_cents": 20001, "quantity": 2})
    assert out[0].unit_cents == 20000 and out[0].per_unit_cents == 2500 and "lot de 2 : 400 € au total" in out[0].notes
    assert out[1].unit_cents == 40000 and out[1].notes[0] == "lot mixte de 2 articles, prix total non divisé"
    assert out[2].unit_cents == 10001  # 10000.5 rounds half up


def test_floor_age_delivery_in_order(spark):
    out = run(spark, {"price_cents": 4999}, {"posted_at": "2025-01-01T00:00:00Z"}, {"posted_at": ""}, {"posted_at": "not a date"},
              {"watch": "strict", "delivery": False}, {"watch": "strict", "delivery": None})
    assert [r.stage for r in out] == ["below_floor", "too_old", "kept", "kept", "no_delivery", "kept"]
    assert out[1].notes[-1] == "annonce publiée il y a 396 jours"


def test_scam_rules(spark):
    out = run(spark, {"price_cents": 13199}, {"price_cents": 13200}, {"seller_reviews": None}, {"seller_reviews": 0, "price_cents": 24000},
              {"shipping_cents": 4001}, {"price_cents": 6000, "shipping_cents": 3001},
              {"delivery": False, "secure_payment": False, "seller_reviews": None, "price_cents": 25000},
              {"delivery": False, "secure_payment": None, "seller_reviews": None, "price_cents": 25000})
    assert out[0].suspicious == ["prix 132 € < 55% de la médiane (240 €)"] and out[1].suspicious == []
    assert out[2].suspicious == ["vendeur sans évaluation et prix sous le marché"] and out[3].suspicious == []
    assert out[4].suspicious == ["frais de port aberrants (40 €)"]
    assert "frais de port aberrants (30 €)" in out[5].suspicious
    assert out[6].suspicious == ["ni livraison, ni paiement sécurisé, vendeur sans historique"] and out[7].suspicious == []


def test_config_resolution():
    w = resolve_watches(RAW)
    assert set(w) == {"w", "strict"} and w["w"]["notify"]["price_drop_pct"] == 5 and w["strict"]["notify"]["require_delivery"]
    assert [t["max_cents"] for t in w["w"]["thresholds"]] == [20000, 30000]
    assert list(resolve_watches({"profile": {"type": "hdd", "title": "Old"}})) == ["hdd"]
    with pytest.raises(ValueError):
        resolve_watches({"watches": {"a": {"enabled": False}}})


def test_any_false_value_switches_a_watch_off():
    raw = {"watches": {"a": {"enabled": None}, "b": {"enabled": 0}, "c": {"enabled": False}, "d": {"enabled": True}, "e": {}, "f": None}}
    assert list(resolve_watches(raw)) == ["d", "e", "f"]

"""Configuration of the watches that the test tables stand for (one per part type)."""

from __future__ import annotations

from pricelens.config import resolve_watches

RAW = {
    "notify": {"enabled": True, "price_drop_pct": 5, "suspicious": "separate", "max_age_days": 120},
    "market": {"history_days": 30, "min_samples": 4, "reference_cents": 200000},
    "scam": {"below_median_pct": 55, "zero_feedback_below_market": True, "max_shipping_cents": 15000,
             "max_shipping_pct": 50},
    "thresholds": [
        {"max_cents": 110000, "priority": "urgent", "tags": ["fire"]},
        {"max_cents": 220000, "priority": "default"},
        {"max_cents": 420000, "priority": "low"},
    ],
    "watches": {
        "PROMO": {"title": "Promo", "notify": {"enabled": False}, "profile": {"type": "keywords"}},
        "SMALL": {"title": "Small", "notify": {"suspicious": "never", "price_drop_pct": 10},
                  "profile": {"type": "keywords"}},
        "ECONOMY": {"title": "Economy", "notify": {"max_age_days": 0}, "market": {"min_unit_cents": 60000},
                    "profile": {"type": "pc"}},
        "LARGE": {"title": "Large", "profile": {"type": "pc"}, "thresholds": [
            {"max_cents": 300000, "priority": "low"},
            {"max_cents": 90000, "priority": "urgent", "tags": ["fire", "star"]},
        ]},
        "STANDARD": {"title": "Standard", "notify": {"max_age_days": 60, "label": "STD"},
                     "profile": {"type": "hdd", "hdd": {"target_capacity_tb": 8}}},
        "MEDIUM": {"title": "Medium", "notify": {"require_delivery": True}, "scam": {"max_shipping_cents": 9000},
                   "profile": {"type": "keywords", "keywords": {"unit_divisor": 3, "unit_label": "€/u"}}},
    },
}

WATCHES = resolve_watches(RAW)
BUDGETS = {"lbc": 12, "ebay": 20, "vinted": 12, "hfr": 15}
SOURCE_LABELS = {"lbc": "LBC", "ebay": "eBay", "vinted": "Vinted", "hfr": "HFR"}
COOLDOWN_HOURS = 12

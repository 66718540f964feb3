"""Profile registry: what a watch needs to know about the kind of object it follows.

A profile is a name, scoring settings and a ``DataFrame -> DataFrame`` classifier. Register your own with
``register``; a classifier that must run Python goes through ``mapInPandas`` inside its ``classify``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens import fixed_values as fv
from pricelens.operators.market import MARKET_NAMES
from pricelens.operators.merging import union_frames

Classifier = Callable[[DataFrame, Mapping[str, Any]], DataFrame]
#: Rows of several watches and the settings of each by name.
ManyClassifier = Callable[[DataFrame, Mapping[str, Mapping[str, Any]]], DataFrame]


@dataclass(frozen=True)
class Profile:
    name: str
    classify: Classifier
    low_flags: tuple[str, ...] = ()
    flag_notes: Mapping[str, str] = field(default_factory=dict)
    attr_labels: Mapping[str, str] = field(default_factory=dict)
    #: Fine and broad name of a classified row in the market, as columns; model and family without one. A null name counts under none.
    market_key: Callable[[], tuple[Column, Column]] | None = None
    #: Classifies rows of watches with different settings in one pass; without one, each set of settings is a pass of its own.
    classify_many: ManyClassifier | None = None

    def scoring(self, cfg: Mapping[str, Any]) -> dict[str, Any]:
        """Scoring columns of ``config.WATCH_DDL`` for one watch."""
        divisor, label = cfg.get("unit_divisor"), cfg.get("unit_label") or ""
        if self.name == "hdd":
            divisor, label = cfg.get("target_capacity_tb", 8), "€/To"
        return {"unit_divisor": float(divisor) if divisor else None, "unit_label": label,
                "low_flags": list(self.low_flags), "flag_notes": dict(self.flag_notes),
                "attr_labels": [{"name": n, "label": v} for n, v in self.attr_labels.items()]}


def _keywords(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    from pricelens.operators.classify_keywords import classify_keywords

    return classify_keywords(df, cfg)


def _keywords_of_watches(df: DataFrame, configs: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    from pricelens.operators.classify_keywords import classify_keywords_of_watches

    return classify_keywords_of_watches(df, configs)


def _drives(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    from pricelens.operators.classify_drives import classify_drives

    return classify_drives(df, cfg)


def _pc(df: DataFrame, cfg: Mapping[str, Any]) -> DataFrame:
    from pricelens.operators.classify_pc import classify_pc

    return classify_pc(df, cfg)


PROFILES: dict[str, Profile] = {
    "hdd": Profile("hdd", _drives,
                   attr_labels={"smart_hours": "SMART (h)", "capacities_gb": "Capacités citées (Go)"}),
    "keywords": Profile("keywords", _keywords, ("family_unknown",), fv.KEYWORDS_FLAG_NOTES,
                        classify_many=_keywords_of_watches),
    "pc": Profile("pc", _pc, tuple(fv.PC_LOW_FLAGS), fv.PC_FLAG_NOTES,
                  {"cpu": "CPU", "ram_gb": "RAM (Go)", "storage_gb": "Stockage (Go)", "storage": "Type",
                   "cpu_score": "Score CPU"}),
}


def register(profile: Profile) -> None:
    PROFILES[profile.name] = profile


def profile_for(watch: Mapping[str, Any]) -> tuple[Profile, Mapping[str, Any]]:
    kind = str(watch["profile"].get("type") or "hdd")
    if kind not in PROFILES:
        raise ValueError(f"unknown profile {kind!r}; known: {', '.join(sorted(PROFILES))}")
    return PROFILES[kind], watch["profile"].get(kind) or {}


def classify_by_watch(df: DataFrame, watches: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Each watch's rows through its own profile. Watches with equal settings share one pass over the data, and so do all watches of a
    profile with ``classify_many``, whatever their settings."""
    kinds: dict[str, dict[str, Mapping[str, Any]]] = {}
    for name, watch in watches.items():
        profile, cfg = profile_for(watch)
        kinds.setdefault(profile.name, {})[name] = cfg
    parts = []
    for kind, configs in kinds.items():
        profile = PROFILES[kind]
        groups: dict[str, list[str]] = {}
        for name, cfg in configs.items():
            groups.setdefault(repr(cfg), []).append(name)
        if profile.classify_many is not None and len(groups) > 1:
            parts.append(profile.classify_many(df.where(F.col("watch").isin(*configs)), configs))
            continue
        for names in groups.values():
            parts.append(profile.classify(df.where(F.col("watch").isin(*names)), configs[names[0]]))
    return union_frames(*parts)


def with_market_names(df: DataFrame, watches: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """``market_fine`` and ``market_broad`` of classified rows: what each watch's profile names them, model and family where it names nothing.

    One expression for all watches; rows stay as they are where no profile has a market key. Price points, snapshots and the market carry the names."""
    own: dict[str, list[str]] = {}
    for name, watch in watches.items():
        profile = profile_for(watch)[0]
        if profile.market_key is not None:
            own.setdefault(profile.name, []).append(name)
    if not own:
        return df
    fine, broad = F.col("model"), F.col("family")
    for kind, names in own.items():
        mine = F.col("watch").isin(*names)
        key = PROFILES[kind].market_key()
        fine, broad = F.when(mine, key[0]).otherwise(fine), F.when(mine, key[1]).otherwise(broad)
    return df.withColumns(dict(zip(MARKET_NAMES, (fine, broad))))

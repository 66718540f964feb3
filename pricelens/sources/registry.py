"""Source registry: name -> (raw pages -> listings). Register your own with ``register``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.merging import union_frames
from pricelens.sources.api_items import api_listings
from pricelens.sources.cards import card_listings, first_cards
from pricelens.sources.embedded_json import ad_listings, search_pages
from pricelens.sources.forum import forum_listings

# Relay shipping by parcel weight (grams, cents).
WEIGHT_STEPS = [(1000, 550), (2000, 690), (5000, 990), (10000, 1390)]


#: What tells the pages of one table apart, where it is there.
PAGE_KEYS = ("watch", "scan_id", "page_id")


@dataclass(frozen=True)
class Source:
    name: str
    listings: Callable[[DataFrame], DataFrame]
    needs_url: bool = False


def _first_cards(pages: DataFrame) -> DataFrame:
    return first_cards(card_listings(pages), [c for c in PAGE_KEYS if c in pages.columns])


def forum_source(queries: Sequence[str] = ()) -> Source:
    """The forum for these searches; register it to narrow the topics down."""
    return Source("hfr", lambda pages: forum_listings(pages, queries), needs_url=True)


SOURCES: dict[str, Source] = {
    "lbc": Source("lbc", lambda pages: ad_listings(search_pages(pages), WEIGHT_STEPS)),
    "ebay": Source("ebay", api_listings),
    "vinted": Source("vinted", _first_cards),
    "hfr": forum_source(),
}


def register(source: Source) -> None:
    SOURCES[source.name] = source


def read_pages(raw_pages: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Listings of every registered source out of one raw page table (partitioned by ``source`` on disk).

    Pages of sources that nobody registered are in ``unread_pages``."""
    parts = []
    for name in only or list(SOURCES):
        pages = raw_pages.where(F.col("source") == name).drop("source")
        if not SOURCES[name].needs_url:
            pages = pages.drop("url")
        elif "url" not in pages.columns:
            if only:
                raise ValueError(f"pages of {name} need their url")
            continue  # a page table without addresses has no topics to read
        parts.append(SOURCES[name].listings(pages))
    return union_frames(*parts)


def unread_pages(raw_pages: DataFrame) -> DataFrame:
    """Pages that ``read_pages`` has no reader for, with the reason in ``error``."""
    known = F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))
    missing = F.lit("url" not in raw_pages.columns) & F.col("source").isin(*[n for n, s in SOURCES.items() if s.needs_url])
    return raw_pages.withColumn("error", F.when(~known, F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null"))))
                                .when(missing, "no url")).where(F.col("error").isNotNull())

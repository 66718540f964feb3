"""Loads every query module so that the registry is complete."""

from __future__ import annotations

import importlib

from pricelens.plans.registry import ORACLE, QUERIES

MODULES = ("listing_queries", "report_queries", "text_queries", "title_grammar", "ingest_queries", "stream_queries", "scan_queries", "whole_scan_queries", "market_queries")


def load():
    for name in MODULES:
        importlib.import_module(f"pricelens.plans.{name}")
    return QUERIES, ORACLE

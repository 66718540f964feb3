"""Configuration tables as single literals inside expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_map(table: Mapping[str, Any], value_ddl: str = "STRING") -> Column:
    """A map literal, written as one JSON text that the optimizer folds once (instead of two literals per entry)."""
    return F.from_json(F.lit(json.dumps(dict(table), ensure_ascii=False)), f"MAP<STRING, {value_ddl}>")


def lookup(table: Mapping[str, Any], key: Column, value_ddl: str = "STRING") -> Column:
    """Value of ``key``, null when it is not in the table."""
    if not table:
        return F.lit(None).cast(value_ddl)
    return F.element_at(literal_map(table, value_ddl), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, for an expensive expression that is used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """``value`` as a generated column, one row for each row: filters on it read what was made instead of making it again, as they do behind a projection."""
    return F.explode(F.array(value))

"""Advancing a listing snapshot by a batch of scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pricelens.operators import history as hi


def advance_state(previous: DataFrame | None, scan_rows: DataFrame, scans: DataFrame,
                  gone_after: int = hi.GONE_AFTER, settings: DataFrame | None = None) -> DataFrame:
    """New snapshot, with the alerts of the batch in its ``alerts`` column. ``scans`` is the whole scan log so far.

    Rows never seen in the batch are kept, seen ones are updated, new ones are added: a full merge by key, done as
    one union and one shuffle because the previous snapshot enters the window as one carried row per listing. ``settings`` are the
    watches (one row each) where rows do not carry ``history.SETTINGS``; these join the timeline without a shuffle.
    """
    lines = hi.timeline(scan_rows, scans, previous, gone_after)
    if settings is not None:
        lines = hi.with_settings(lines, settings)
    return hi.snapshot(lines, scans, True, gone_after)

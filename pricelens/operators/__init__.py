"""DataFrame -> DataFrame transforms: merging, scoring, market, state, alerts, reports, classification."""

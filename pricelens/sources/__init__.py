"""Observation tables, captured payload parsers and sinks."""

"""Structured Streaming jobs over the same transforms as the batch path."""

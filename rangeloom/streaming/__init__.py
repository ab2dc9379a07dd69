"""Streaming of the range-aggregate engine."""

"""Operators of the range-aggregate engine."""

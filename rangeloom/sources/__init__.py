"""Sources of the range-aggregate engine."""

"""Plans of the range-aggregate engine."""

"""Functions of the range-aggregate engine."""

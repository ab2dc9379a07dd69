"""Range-aggregate analytics on Spark: workload-aware layouts, exact pruning, plain DataFrame plans."""

"""Query catalogue: Spark callables and their SQL twins."""

"""A Spark-first engine for match-level sports history and large text corpora."""

"""sievework: a Spark-first engine for URL risk analytics."""

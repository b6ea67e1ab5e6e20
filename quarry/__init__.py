"""quarry: a Spark-first analytics engine."""

"""A Spark-first record-linkage and candidate-retrieval engine."""

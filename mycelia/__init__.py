"""Concept-graph analytics on PySpark: DataFrame and SQL plans only, no engine of its own."""

"""Sources of the concept-graph engine."""

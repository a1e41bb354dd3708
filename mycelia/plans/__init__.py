"""Plans of the concept-graph engine."""

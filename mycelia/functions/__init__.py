"""Functions of the concept-graph engine."""

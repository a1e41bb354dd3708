"""Operators of the concept-graph engine."""

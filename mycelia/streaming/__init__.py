"""Streaming of the concept-graph engine."""

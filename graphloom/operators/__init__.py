"""Operators of the graph engine."""

"""Streaming of the graph engine."""

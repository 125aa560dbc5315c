"""Relational operators over token, graph, tuple and score tables."""

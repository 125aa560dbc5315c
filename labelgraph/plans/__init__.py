"""Compositions of operators and the stage registry."""

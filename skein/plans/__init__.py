"""Whole jobs composed of operators, and the graphs and corpora derived from the given tables."""

"""Operators on two-sided features: creation, counts, orders, corners, graphs, analysis."""

"""Operators on series, connectivity, states and their comparison."""

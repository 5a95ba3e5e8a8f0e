"""Measures, grids and registered queries."""

"""Whole flows built from the operators, and the query catalogue."""

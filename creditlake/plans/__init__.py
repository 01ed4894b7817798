"""Compositions of operators, and the catalogue of runnable queries."""

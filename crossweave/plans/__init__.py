"""Whole analyses: the mapping session, and the catalogue of queries."""

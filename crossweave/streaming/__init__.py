"""Hits that arrive over time."""

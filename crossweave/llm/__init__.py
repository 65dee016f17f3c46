"""Operators that prepare a text corpus for language-model training.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""

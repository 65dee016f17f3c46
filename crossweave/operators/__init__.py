"""The engine's operators. Sparse matrices are frames (i, j, v) of their non-zeros; names are keys."""

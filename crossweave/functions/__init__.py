"""Column expressions: names and pairs, packed strings, numeric shaping."""

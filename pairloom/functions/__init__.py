"""Column-level building blocks: text, array, vector and statistics expressions."""

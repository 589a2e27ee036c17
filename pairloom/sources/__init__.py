"""Readers and writers for pair tables, vectors, dictionaries and predictions."""

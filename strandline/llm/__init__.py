"""Operators for large corpora and huge identifier sets. Nothing outside imports this."""

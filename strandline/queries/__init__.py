"""Registered queries of the core, with their SQL where SQL can express them."""

"""Registered queries: name to (Spark query, oracle SQL or None)."""

"""Whole queries: the entry points and the named test queries."""

"""Operators over (item, group, vector, time) tables."""

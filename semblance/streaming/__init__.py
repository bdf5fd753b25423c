"""Micro-batch runs of the entry points."""

"""Readers and writers of the tables that the engine keeps."""

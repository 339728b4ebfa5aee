"""Readers and writers for the catalog tables and the retrieval index."""

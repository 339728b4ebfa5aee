"""Structured Streaming forms of the trace summary and the line audit."""

"""Composed operators and the queries registered in ``__spark_entry__``."""

"""Catalog analytics as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  A missing value is *unknown* throughout; it is never a failure.
"""

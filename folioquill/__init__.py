"""folioquill: document analytics as PySpark DataFrames."""

"""Web-corpus analytics as PySpark DataFrames."""

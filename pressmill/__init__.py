"""News, procurement and market intelligence operators on PySpark."""

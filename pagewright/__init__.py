"""Page-text analytics on PySpark."""

"""Literature retrieval and corpus processing on PySpark."""

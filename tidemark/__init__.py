"""Journal analytics and training-data processing on PySpark."""

"""kerbline: path-width analytics and corpus preparation as PySpark jobs."""

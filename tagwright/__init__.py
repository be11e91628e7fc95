"""tagwright: label large text collections and compare classification
methods with PySpark DataFrame, SQL and Spark ML jobs."""

__version__ = "0.1.0"

"""Missing-data analytics and training-data preparation on Apache Spark."""

__version__ = "0.1.0"

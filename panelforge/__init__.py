"""Panel analytics and training-data processing on Spark."""

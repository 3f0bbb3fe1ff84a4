"""Market-catalogue and training-data jobs on Spark."""

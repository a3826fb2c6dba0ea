"""Preparation, validation, models and scores on Spark ML."""

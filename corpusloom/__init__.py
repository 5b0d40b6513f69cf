"""Spark operators that turn many raw tables into training-ready, fixed-schema data."""

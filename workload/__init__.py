"""Queries over the test tables, each in Spark and in SQL."""

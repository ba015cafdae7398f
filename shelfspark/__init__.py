"""Catalog analytics on Spark: DataFrame operators for document libraries."""

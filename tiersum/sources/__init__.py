"""Reads of Parquet tables and views shaped like a forecast hierarchy."""

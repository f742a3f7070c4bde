"""Credential discovery, redaction and training-data preparation on Spark DataFrames."""

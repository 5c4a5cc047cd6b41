"""Tokenloom: language-model data preparation and run analytics on PySpark DataFrames."""

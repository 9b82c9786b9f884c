"""Operators of a training-data pipeline over Spark DataFrames; nothing else in the library imports them."""

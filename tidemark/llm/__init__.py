"""Operators of a training-data pipeline, and the queries over them."""

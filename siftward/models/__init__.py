"""Encoding, splitting, training, voting and evaluation on Spark ML."""

"""Spam and typosquatting risk features for software packages, as Spark jobs."""

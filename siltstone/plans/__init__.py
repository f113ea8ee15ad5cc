"""Whole plans: the corpus build, and the queries that the driver runs."""

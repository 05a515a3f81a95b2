"""Placing sets of overlapping drawing sheets with Spark."""

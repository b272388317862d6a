"""Duplicate detection for master data on Spark."""

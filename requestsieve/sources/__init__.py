"""Readers, sinks and the tables derived from the sample data."""

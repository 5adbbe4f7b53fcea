"""Whole jobs: the classification cascade and the log analytics."""

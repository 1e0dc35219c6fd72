"""Whole runs: operators in order, with every result stored as a table."""

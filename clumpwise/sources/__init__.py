"""Readers, views of the test tables, and parameters."""

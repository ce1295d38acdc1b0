"""Restartable work and streams."""

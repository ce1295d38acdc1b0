"""Registered queries and the programs end to end."""

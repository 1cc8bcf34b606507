"""Continuous versions of log roll-ups."""

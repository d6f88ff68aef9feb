"""Logs that are followed as they grow."""

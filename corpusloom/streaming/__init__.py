"""Streaming folds of the session log."""

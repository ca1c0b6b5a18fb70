"""Streaming twins of the batch analytics."""

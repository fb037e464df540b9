"""Queries over streams; each also runs on a batch of the same columns."""

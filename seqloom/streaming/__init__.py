"""Incremental counts over streams."""

"""Operators on tokens, graphs and sequence models."""

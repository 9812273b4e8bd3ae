"""Operators that keep state between micro-batches."""

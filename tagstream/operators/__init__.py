"""Operators on frames, blocks and readings."""

"""Stateful operators on streams."""

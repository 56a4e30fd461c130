"""Operators on pages, instances and fields."""

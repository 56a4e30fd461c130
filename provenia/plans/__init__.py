"""Schemas, and the plans compiled from them."""

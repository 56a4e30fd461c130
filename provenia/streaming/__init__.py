"""The same plans on streams."""

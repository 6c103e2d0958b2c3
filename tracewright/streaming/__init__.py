"""The same jobs on streams."""

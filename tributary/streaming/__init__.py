"""streaming of the tributary engine."""

"""sources of the tributary engine."""

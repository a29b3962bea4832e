"""operators of the tributary engine."""

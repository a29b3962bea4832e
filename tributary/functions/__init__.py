"""functions of the tributary engine."""

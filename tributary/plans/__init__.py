"""plans of the tributary engine."""

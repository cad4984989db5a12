"""operators of the annotation engine."""

"""streaming of the annotation engine."""

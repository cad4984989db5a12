"""sources of the annotation engine."""

"""functions of the annotation engine."""

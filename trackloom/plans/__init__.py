"""plans of the annotation engine."""

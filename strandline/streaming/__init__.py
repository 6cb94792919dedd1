"""streaming of the lineage engine."""

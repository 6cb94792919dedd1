"""sources of the lineage engine."""

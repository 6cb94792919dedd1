"""operators of the lineage engine."""

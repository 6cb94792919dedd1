"""functions of the lineage engine."""

"""plans of the lineage engine."""

"""Citation-lineage analytics as composable Spark DataFrame operators."""

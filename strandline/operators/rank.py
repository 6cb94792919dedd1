"""Places within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def placed(rows: DataFrame, group: list[str], order: list, spread: bool = True) -> DataFrame:
    """``rows`` with ``nth`` (from 0, by ``order`` within ``group``) and ``n`` (rows of the group); null groups are groups.

    Rows are dealt by ranges of (group, order) and written down; a row's place
    is its place in its range and the size of its group's ranges before, of
    which there is a row for each. So no group has to fit a task. ``spread``
    can be turned off for tables that a limit has cut.
    """
    if not spread:
        own = Window.partitionBy(*group)
        return rows.withColumn("nth", F.row_number().over(own.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    at = stored(rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*[f"__{g}" for g in group])
    sizes = at.groupBy(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(own.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).withColumn("n", F.sum("__c").over(own))
    within = Window.partitionBy(*group, "__range").orderBy(*order)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__range") == F.col("__of"))
    found = at.withColumn("__i", F.row_number().over(within) - 1).join(sizes, same)
    return found.select(*rows.columns, (F.col("__before") + F.col("__i")).alias("nth"), "n")

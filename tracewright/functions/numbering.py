"""Places in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group is cut into.
RANGES = 64


def numbered(rows: DataFrame, by: list[str], first: Column, then: list[str], name: str = "place") -> DataFrame:
    """rows with their place (1 ..) within their group, in order of a number and, where that ties, of more columns.

    Percentiles of the number cut a group into ranges, which are numbered apart and follow each other, so that no task holds
    a group that is a third of all rows. Null numbers come first.
    """
    keyed = rows.withColumn("__first", first)
    cuts = keyed.groupBy(*by).agg(F.percentile_approx("__first", [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
    keyed = keyed.join(cuts, by).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__first"))), F.lit(-1))).drop("__cuts")
    sizes = keyed.groupBy(*by, "__range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*by, "__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(F.col("__first").asc_nulls_first(), *then))
    return keyed.join(offsets, [*by, "__range"]).withColumn(name, (F.col("__before") + within).cast("int")).drop("__first", "__range", "__before").select(*rows.columns, name)

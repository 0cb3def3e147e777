"""Ranks over rows of any number: by ranges, so that no task sees more than a range.

Defined results: the order should be total, or rows that are equal in it get their ranks as they come;
NULLs stand where the order puts them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselite.session import materialize


def range_ranked(rows: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """The rows with their rank from 1, in each group or over all.

    Rows are cut into ranges of group and order; a row's rank is its number within its range and the rows of
    its group in the ranges before, of which there is one count for each range and group.
    """
    columns = rows.columns
    ranges = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    ranges = materialize(ranges, "ranges")
    counts = ranges.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(before, F.lit(0)).alias("_before"))
    within = ranges.withColumn("_within", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)))
    same = within["_range"] == counts["_range"]
    for g in group:
        same = same & within[g].eqNullSafe(counts[f"_g_{g}"])
    return within.join(counts, same).select(*[within[c] for c in columns], (F.col("_before") + F.col("_within")).cast("int").alias(rank))

"""One ranking from several differently-scaled scores: closeness to an ideal point.

Within each group the scores are winsorised at two quantiles and vector-normalised: each is taken from its
mean and divided by the length of the vector of these deviations, so a score's zero, unit and range fall
away, and a few extreme values have been cut before. Then the weighted distances of a candidate to the
ideal point (the best of each score) and to the anti-ideal point (the worst of each) give its relative
closeness d- / (d- + d+), by which the group is ranked.

Defined results: a NULL or NaN score stands at the anti-ideal, so it gives no support; a score that is
constant within the group, or NULL throughout, has no span and decides nothing, and if no score has one
every candidate has closeness 0; candidates delivered twice count once (the greatest of each score);
ties go to the smaller item id; an empty table gives no rows. Quantiles are approximate aggregates of
bounded size, rank limits are taken before the shuffle, and a whole ranking is made by ranges, so no group
is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselite.operators.ordering import range_ranked


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def closeness(
    scores: DataFrame,
    *,
    group: str,
    item: str,
    better: Mapping[str, int],
    weights: Mapping[str, float] | None = None,
    winsor: float = 0.2,
    accuracy: int = 10_000,
) -> DataFrame:
    """group, item, closeness. better: each score's name with 1 if more is better, -1 if less is."""
    names = list(better)
    sided = [(F.when(F.isnan(F.col(n).cast("double")), None).otherwise(F.col(n).cast("double")) * better[n]).alias(f"_s{i}") for i, n in enumerate(names)]
    rows = scores.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *sided).where(F.col("_g").isNotNull() & F.col("_i").isNotNull())
    rows = rows.groupBy("_g", "_i").agg(*[F.max(f"_s{i}").alias(f"_s{i}") for i in range(len(names))])
    quantiles = [F.percentile_approx(f"_s{i}", F.array(F.lit(winsor), F.lit(1 - winsor)), F.lit(accuracy)).alias(f"_q{i}") for i in range(len(names))]
    limits = rows.groupBy("_g").agg(*quantiles)
    # greatest and least skip NULL, so a missing score would become a limit
    cut = rows.join(limits, "_g").select("_g", "_i", *[F.when(F.col(f"_s{i}").isNotNull(), F.greatest(F.least(f"_s{i}", F.col(f"_q{i}")[1]), F.col(f"_q{i}")[0])).alias(f"_s{i}") for i in range(len(names))])
    # stddev_pop times the root of the count is the length of the deviations, without the loss of a difference of squares
    length = "sqrt(count({0})) * stddev_pop({0})"
    norms = cut.groupBy("_g").agg(*[x for i in range(len(names)) for x in (F.expr(length.format(f"_s{i}")).alias(f"_n{i}"), F.min(f"_s{i}").alias(f"_lo{i}"), F.max(f"_s{i}").alias(f"_hi{i}"))])
    whole = cut.join(norms, "_g")
    up, down = [], []
    for i, n in enumerate(names):
        # the mean is the same for all and falls out of every distance
        weight = F.lit(float((weights or {}).get(n, 1.0))) / F.col(f"_n{i}")
        value, real = F.coalesce(f"_s{i}", f"_lo{i}"), F.col(f"_hi{i}") > F.col(f"_lo{i}")
        up.append(F.when(real, (weight * (F.col(f"_hi{i}") - value)) ** 2).otherwise(0.0))
        down.append(F.when(real, (weight * (value - F.col(f"_lo{i}"))) ** 2).otherwise(0.0))
    plus, minus = F.sqrt(_sum(up)), F.sqrt(_sum(down))
    value = F.when(plus + minus > 0, minus / (plus + minus)).otherwise(0.0)
    return whole.select(F.col("_g").alias(group), F.col("_i").alias(item), F.round(value, 9).alias("closeness"))


def ranked(closed: DataFrame, *, group: str, item: str, top: int | None = None) -> DataFrame:
    """group, item, closeness, rank; the first `top` of each group, or all."""
    order = [F.desc("closeness"), F.col(item)]
    if top is None:
        return range_ranked(closed, order, [group])
    return closed.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= top)

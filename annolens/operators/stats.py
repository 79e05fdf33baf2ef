"""Agreement, correlation and set overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreement(decisions: DataFrame, expected: str = "expected", needed: str = "needed") -> DataFrame:
    """One row: counts by what was expected, agreement, always_says_yes and discrimination.

    Discrimination is the rate of "needed" where it was expected minus the rate where it was not.
    """
    e, n = F.col(expected), F.col(needed)
    sums = decisions.agg(
        F.count_if(e).alias("commented"), F.count_if(e & n).alias("commented_needed"), F.count_if(~e).alias("uncommented"), F.count_if(~e & n).alias("uncommented_needed"),
        F.avg((e == n).cast("int")).alias("agreement"), F.bool_and(n).alias("always_says_yes"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return sums.withColumn("discrimination", rate("commented_needed", "commented") - rate("uncommented_needed", "uncommented"))


def correlation(x: str, y: str) -> Column:
    """Pearson's r, null where a side does not vary (corr itself divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def micro_jaccard(sets: DataFrame, unit: str, side: str, item: str) -> DataFrame:
    """(unit, overlap): items on both sides over items on either; one aggregation in place of a full outer join."""
    s = F.col(side)
    items = sets.groupBy(unit, item).agg(F.bool_or(s == 0).alias("_a"), F.bool_or(s == 1).alias("_b"))
    return items.groupBy(unit).agg(F.try_divide(F.count_if(F.col("_a") & F.col("_b")), F.count("*")).alias("overlap"))

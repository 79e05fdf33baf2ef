"""Paired arms: deltas, outcomes, raters, exclusions and the advisory screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arm_deltas(rows: DataFrame, key: str, arm: str, value: str, without: str, with_: str) -> DataFrame:
    """(key, delta): mean value of one arm minus the other's, for units that have both; one aggregation, no self-join."""
    means = rows.groupBy(key).agg(*[F.avg(F.when(F.col(arm) == a, F.col(value))).alias(n) for a, n in ((without, "_a"), (with_, "_b"))])
    return means.select(key, (F.col("_b") - F.col("_a")).alias("delta")).where("delta is not null")


def outcome_counts(deltas: DataFrame, delta: str) -> DataFrame:
    """(wins, ties, losses, mean_delta): lower is better."""
    d = F.col(delta)
    return deltas.agg(F.count_if(d < 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d > 0).alias("losses"), F.avg(d).alias("mean_delta"))


def inter_rater(rows: DataFrame, first: str, second: str) -> DataFrame:
    """(pairs, mean_absolute_difference, exact_agreement) of two grades of a row; rows that lack one are left out."""
    a, b = F.col(first), F.col(second)
    return rows.where(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("pairs"), F.avg(F.abs(a - b)).alias("mean_absolute_difference"), F.avg((a == b).cast("int")).alias("exact_agreement"))


def first_two(judgments: str, key: str) -> tuple:
    """A grade of the first and of the second judgment of an array, null where there is none."""
    return F.get(F.col(judgments), F.lit(0))[key], F.get(F.col(judgments), F.lit(1))[key]


def exclude_pairs(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Units of which no arm is excluded."""
    return rows.join(excluded.select(key), key, "left_anti")


def advisory_screen(deltas: DataFrame, delta: str, severe: float) -> DataFrame:
    """(passes): no severe regression and no worse on average. It informs and promotes nothing."""
    d = F.col(delta)
    return deltas.agg((~F.bool_or(d >= severe) & (F.avg(d) <= 0)).alias("passes"))

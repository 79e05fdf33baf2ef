"""Joins that must find something: the first of several matches, and a refusal inside the plan where there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in `order`: one aggregation with a partial result a task, however many rows a key has."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def matched(rows: DataFrame, others: DataFrame, keys: list[str], order: list[str | Column] | None = None, *, what: str = "row without a match", refuse: bool = True) -> DataFrame:
    """rows with the columns of their match among `others`: the first in `order`, or the only one if no order is given.

    A row without a match ends the query with `what` and its keys; with refuse=False it comes back with nulls and `refused`, a text, so that
    a caller can list all of them. Null keys match nothing.
    """
    one = (first_of(others, keys, order) if order else others).withColumn("_there", F.lit(True))
    joined = rows.join(one, keys, "left")
    named = F.concat(F.lit(f"{what}: "), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]))
    if not refuse:
        return joined.withColumn("refused", F.when(F.col("_there").isNull(), named)).drop("_there")
    # The check is a filter, so no later choice of columns can leave it out of the plan.
    return joined.where(F.coalesce(F.col("_there"), F.raise_error(named).cast("boolean"))).drop("_there")

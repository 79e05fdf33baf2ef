"""Conditional pass rates down an ordered list of criteria."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _held(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def standing(rows: DataFrame, criteria: list[str]) -> DataFrame:
    """(rung, criterion, judged, passed, rate_of_standing, rate_of_all): one row a criterion, in order.

    A row counts for a rung if it passed all before; a null verdict is not judged and leaves the ladder. Rates with nothing
    to divide by are null. One pass over the rows.
    """
    sums = [F.count("*").alias("cases")]
    for k, name in enumerate(criteria):
        before = reduce(lambda a, b: a & b, map(_held, criteria[:k]), F.lit(True))
        sums += [F.count_if(before & F.col(name).isNotNull()).alias(f"j{k}"), F.count_if(before & _held(name)).alias(f"p{k}")]
    total = rows.agg(*sums)
    rungs = [F.struct(F.lit(k).alias("rung"), F.lit(c).alias("criterion"), F.col(f"j{k}").alias("judged"), F.col(f"p{k}").alias("passed")) for k, c in enumerate(criteria)]
    flat = total.select("cases", F.explode(F.array(*rungs)).alias("r")).select("cases", "r.*")
    return flat.select("rung", "criterion", "judged", "passed", F.try_divide("passed", "judged").alias("rate_of_standing"), F.try_divide("passed", "cases").alias("rate_of_all"))


def first_failure(criteria: list[str]) -> Column:
    """The first criterion that a row fails; one without a verdict is passed over; 'none' if none fails."""
    return F.coalesce(*[F.when(~F.col(c), c) for c in criteria], F.lit("none"))


def order_violations(rows: DataFrame, criteria: list[str], key: str, shown: int = 20) -> DataFrame:
    """(harder, easier, cases, ids): rows that pass a criterion and fail the one before; ids are the first `shown`.

    The ids of a pair are a bounded aggregate: each task keeps its least `shown` and no more.
    """
    parts = []
    for easier, harder in zip(criteria, criteria[1:], strict=False):
        hit = F.col(harder) & ~F.col(easier)
        counted = rows.agg(F.count_if(hit).alias("cases"))
        ids = rows.where(hit).select(key).orderBy(key).limit(shown).agg(F.array_sort(F.collect_list(key)).alias("ids"))
        parts.append(counted.join(ids).select(F.lit(harder).alias("harder"), F.lit(easier).alias("easier"), "cases", "ids"))
    return reduce(DataFrame.unionByName, parts)

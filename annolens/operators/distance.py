"""Distances between two texts of a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.functions.text import words


def js_divergence(pairs: DataFrame, key: str, candidate: str, reference: str) -> DataFrame:
    """(key, js): base-2 Jensen-Shannon divergence of the two texts' word distributions.

    An empty side has no mass. Both bags are exploded once with a side tag and counted per (key, word); the sides' totals come from
    the same arrays, so the words are shuffled once and there is no join.
    """
    sides = pairs.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), words(F.col(candidate)).alias("w")), F.struct(F.lit(1).alias("side"), words(F.col(reference)).alias("w")))).alias("s"), words(F.col(candidate)).alias("_a"), words(F.col(reference)).alias("_b"))
    tokens = sides.select(key, "s.side", F.greatest(F.size("_a"), F.lit(1)).alias("na"), F.greatest(F.size("_b"), F.lit(1)).alias("nb"), F.explode_outer("s.w").alias("word"))
    counts = tokens.groupBy(key, "word").agg(
        (F.count_if((F.col("side") == 0) & F.col("word").isNotNull()) / F.max("na")).alias("p"), (F.count_if((F.col("side") == 1) & F.col("word").isNotNull()) / F.max("nb")).alias("q")
    )
    middle = (F.col("p") + F.col("q")) / 2
    term = F.when(F.col("p") > 0, 0.5 * F.col("p") * F.log2(F.col("p") / middle)).otherwise(0.0) + F.when(F.col("q") > 0, 0.5 * F.col("q") * F.log2(F.col("q") / middle)).otherwise(0.0)
    return counts.groupBy(key).agg(F.sum(term).alias("js"))

"""Connected components by alternating large and small stars.

Each round is two grouped minima and two joins over the edge list, which shrinks towards one star a
component; the number of rounds is logarithmic in the component's diameter. Edges never leave the cluster,
the only thing the driver sees is one checksum a round, and each round's edges are a table in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import materialize, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge (u, v) names; component is the least node reachable.

    Self-loops and nulls name no node of use and are left out, repeated edges count once, and an
    empty edge list gives an empty result.
    """
    spark = edges.sparkSession
    kept = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    kept = materialize(kept, name)
    seen = None
    for _ in range(rounds):
        mark = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        following = materialize(_small_star(_large_star(kept)), name)
        remove(spark, kept)
        kept = following
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""The summary of a paired study, in long form.

Grades come as (id, repeat, judge, arm, dimension, grade), one row a grade. Lower is better. Every part is one aggregation over that
frame; the parts are unions of small rows, so a summary is a table like any other.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolens.operators.validate import DIMENSIONS

ARMS = ("without_spec", "with_spec", "upstream")
STYLE = DIMENSIONS[:4]  # of a study with other names, its first four
#: A deficit from which a reader notices.
NOTICEABLE = 2
SEED = 20260911


def long_grades(rows: DataFrame) -> DataFrame:
    """Grades from rows (id, repeat, judgments array of maps arm -> map dimension -> grade, judge the same for older rows)."""
    judgments = F.when(F.size("judgments") > 0, F.col("judgments")).otherwise(F.array("judge"))
    each = rows.select("id", "repeat", F.posexplode(judgments).alias("judge", "g")).select("id", "repeat", "judge", F.explode("g").alias("arm", "d"))
    return each.select("id", "repeat", "judge", "arm", F.explode("d").alias("dimension", "grade"))


def unit_means(grades: DataFrame) -> DataFrame:
    """(id, repeat, arm, dimension, grade) averaged over judges."""
    return grades.groupBy("id", "repeat", "arm", "dimension").agg(F.avg("grade").alias("grade"))


def deltas(means: DataFrame) -> DataFrame:
    """(id, repeat, dimension, delta): with the guide minus without, for units that have both."""
    both = means.groupBy("id", "repeat", "dimension").agg(*[F.max(F.when(F.col("arm") == a, F.col("grade"))).alias(a) for a in ARMS[:2]])
    return both.select("id", "repeat", "dimension", (F.col("with_spec") - F.col("without_spec")).alias("delta")).where("delta is not null")


def summarize(grades: DataFrame) -> DataFrame:
    """(metric, arm, dimension, value): mean grades, mean deltas, wins, ties, losses, regressions and agreement of the first two judges."""
    means = unit_means(grades)
    delta = deltas(means)
    mean = means.groupBy("arm", "dimension").agg(F.avg("grade").alias("value")).select(F.lit("mean_grade").alias("metric"), "arm", "dimension", "value")
    d = F.col("delta")
    parts = {"mean_delta": F.avg(d), "wins": F.count_if(d < 0), "ties": F.count_if(d == 0), "losses": F.count_if(d > 0), "severe": F.count_if(d >= 2)}
    paired = delta.groupBy("dimension").agg(*[v.cast("double").alias(k) for k, v in parts.items()]).unpivot("dimension", list(parts), "metric", "value").select("metric", F.lit(None).cast("string").alias("arm"), "dimension", "value")
    first = grades.where("judge in (0, 1)").groupBy("id", "repeat", "arm", "dimension").agg(F.max(F.when(F.col("judge") == 0, F.col("grade"))).alias("a"), F.max(F.when(F.col("judge") == 1, F.col("grade"))).alias("b"))
    rated = {"mean_absolute_difference": F.avg(F.abs(F.col("a") - F.col("b"))), "exact_agreement": F.avg((F.col("a") == F.col("b")).cast("double"))}
    raters = first.where("a is not null and b is not null").groupBy("dimension").agg(*[v.cast("double").alias(k) for k, v in rated.items()])
    raters = raters.unpivot("dimension", list(rated), "metric", "value").select("metric", F.lit(None).cast("string").alias("arm"), "dimension", "value")
    return mean.unionByName(paired).unionByName(raters)


def passes_screen(grades: DataFrame, style: tuple[str, ...] = STYLE) -> DataFrame:
    """(passes): no severe regression of meaning, meaning and usefulness no worse, some dimension of style better. Advisory."""
    by = deltas(unit_means(grades)).groupBy("dimension").agg(F.avg("delta").alias("m"), F.max("delta").alias("worst"))
    at = lambda name, c: F.max(F.when(F.col("dimension") == name, F.col(c)))
    better = F.bool_or(F.col("dimension").isin(*style) & (F.col("m") < 0))
    return by.agg(((at("meaning", "worst") < 2) & (at("meaning", "m") <= 0) & (at("usefulness", "m") <= 0) & better).alias("passes"))


def criteria(grades: DataFrame, measured: DataFrame, optimal: DataFrame | None = None, style: tuple[str, ...] = STYLE) -> DataFrame:
    """(id, repeat, arm, precondition, clean, effective, invasive, optimal, deficits, upstream_deficits, beats_upstream) of each generated answer.

    measured: (id, repeat, arm, band, restatement, foreign_per_100) for every arm, upstream included; optimal: (id, repeat, arm, passed)
    or nothing, then the last verdict is null: not judged. deficits and upstream_deficits map each dimension of style to its mean grade; an answer beats upstream if
    none of its grades is higher. An upstream that was not graded leaves that null.
    """
    each = Window.partitionBy("id", "repeat", "dimension")
    means = unit_means(grades).withColumn("up", F.max(F.when(F.col("arm") == "upstream", F.col("grade"))).over(each))
    at = lambda name: F.max(F.when(F.col("dimension") == name, F.col("grade"))).alias(name)
    styled = F.col("dimension").isin(*style)
    by_name = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(styled, F.struct("dimension", c)))))
    wide = means.groupBy("id", "repeat", "arm").agg(
        at("meaning"), at("usefulness"), F.max(F.when(styled, F.col("grade"))).alias("style"), by_name("grade").alias("deficits"), by_name("up").alias("upstream_deficits"),
        F.bool_and(F.when(styled, F.col("grade") <= F.col("up"))).alias("beats_upstream"),
    )
    upstream = measured.where("arm = 'upstream'").select("id", "repeat", *[F.col(c).alias(f"up_{c}") for c in ("band", "restatement", "foreign_per_100")])
    rows = wide.where("arm <> 'upstream'").join(measured, ["id", "repeat", "arm"]).join(upstream, ["id", "repeat"])
    verdict = optimal.select("id", "repeat", "arm", F.col("passed").alias("optimal")) if optimal is not None else None
    rows = rows.join(verdict, ["id", "repeat", "arm"], "left") if verdict is not None else rows.withColumn("optimal", F.lit(None).cast("boolean"))
    return rows.select(
        "id", "repeat", "arm", (F.col("meaning") < NOTICEABLE).alias("precondition"), (F.col("style") < NOTICEABLE).alias("clean"), ((F.col("band") == F.col("up_band")) & (F.col("usefulness") < NOTICEABLE)).alias("effective"),
        ((F.col("restatement") <= F.col("up_restatement")) & (F.col("foreign_per_100") <= F.col("up_foreign_per_100"))).alias("invasive"), "optimal", "deficits", "upstream_deficits", "beats_upstream",
    )


def seeded_intervals(delta: DataFrame, samples: int = 5000, seed: int = SEED, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """(dimension, mean, low, high): percentile intervals with Python's generator, so that published ones can be matched bit by bit.

    A dimension's values are drawn in the order of (id, repeat), under the seed plus the dimension's place. They are one row a case of
    a study, so one group fits a task; hash_bootstrap() is the form for more.
    """

    def one(batch: pd.DataFrame) -> pd.DataFrame:
        values = batch.sort_values(["id", "repeat"])["delta"].tolist()
        name = batch["dimension"].iloc[0]
        draw = random.Random(seed + dimensions.index(name))
        found = sorted(sum(draw.choice(values) for _ in values) / len(values) for _ in range(samples))
        return pd.DataFrame([(name, sum(values) / len(values), found[int(samples * 0.025)], found[int(samples * 0.975)])], columns=["dimension", "mean", "low", "high"])

    return delta.groupBy("dimension").applyInPandas(one, "dimension string, mean double, low double, high double")


def tasks(cases: DataFrame, arms: tuple[str, ...] = ARMS[:2], repeats: int = 1, seed: int = SEED) -> DataFrame:
    """(id, arm, repeat, place): every answer a study asks for, in an order that a hash of the seed gives."""
    each = cases.select("id", F.explode(F.array(*map(F.lit, arms))).alias("arm")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return each.withColumn("place", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), "arm", F.col("repeat").cast("string")), 256))


def file_sets(rows: DataFrame, least: int = 3) -> DataFrame:
    """(path, arm, comments): answers of a file in the order of their lines, for files with enough of them."""
    w = Window.partitionBy("path", "arm")
    return rows.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least).groupBy("path", "arm").agg(F.array_sort(F.collect_list(F.struct("line", "comment"))).alias("comments"))


def markdown(table: DataFrame, most: int = 1000) -> Iterator[str]:
    """A small summary as the lines of a Markdown table; a larger frame is no report and is refused."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    yield "| " + " | ".join(table.columns) + " |"
    yield "|" + " --- |" * len(table.columns)
    for r in rows:
        yield "| " + " | ".join("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |"

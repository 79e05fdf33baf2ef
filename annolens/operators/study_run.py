"""A whole paired study over saved answers and judgments, as stages; and its lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.operators.stages import Stage
from annolens.operators.summary import ARMS, deltas, summarize, unit_means

#: Ids that a list in a summary holds at most; counts are of all.
SHOWN = 100


def exclusions(rejected: DataFrame, order: str | None = None) -> DataFrame:
    """(id, repeat, arms): each excluded pair with a map from arm to the reason why its answer does not count, the first in `order` if an arm has several.

    rejected: (id, repeat, arm, reason). A pair's map has one entry an arm.
    """
    one = rejected.groupBy("id", "repeat", "arm").agg((F.min_by("reason", order) if order else F.min("reason")).alias("reason"))
    return one.groupBy("id", "repeat").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", "reason")))).alias("arms"))


def first_ids(rows: DataFrame, by: str, hit: Column, order: list[str], shown: int = SHOWN) -> DataFrame:
    """(by, n, ids): of each group how many rows are hit, and the ids of the first of them in order. A task keeps `shown` rows a group at most before the shuffle."""
    ranked = rows.where(hit).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= shown)
    lists = ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"]).alias("ids"))
    counts = rows.groupBy(by).agg(F.count_if(hit).alias("n"))
    return counts.join(lists, by, "left").select(by, "n", F.coalesce("ids", F.array().cast(dict(lists.dtypes)["ids"])).alias("ids"))


def regressions(grades: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(dimension, regressions, ids, severe, severe_ids): answers that the guide made worse, by one grade or by two and more, in the order of id and repeat."""
    delta, order = deltas(unit_means(grades)), ["id", "repeat"]
    worse = first_ids(delta, "dimension", F.col("delta") > 0, order, shown).select("dimension", F.col("n").alias("regressions"), "ids")
    severe = first_ids(delta, "dimension", F.col("delta") >= 2, order, shown).select("dimension", F.col("n").alias("severe"), F.col("ids").alias("severe_ids"))
    return worse.join(severe, "dimension")


def study_stages(reason: Column, repeats: int = 1) -> list[Stage]:
    """The stages of a study over `cases` (id), `answers` (id, repeat, arm, answer) and `grades` (id, repeat, judge, arm, dimension, grade).

    reason: why an answer does not count, null if it does. An excluded answer is never asked for again; it takes its pair out of the study, and the study's counts say so.
    """

    def generated(cases: DataFrame, answers: DataFrame) -> DataFrame:
        wanted = cases.select("id", F.explode(F.array(*map(F.lit, ARMS[:2]))).alias("arm")).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        met = wanted.join(answers.withColumn("_there", F.lit(True)), ["id", "repeat", "arm"], "left")
        return met.select("id", "repeat", "arm", "answer", F.when(F.col("_there").isNull(), "no answer").otherwise(reason).alias("reason"))

    def excluded(rows: DataFrame) -> DataFrame:
        return exclusions(rows.where("reason is not null"))

    def judged(rows: DataFrame, out: DataFrame, grades: DataFrame) -> DataFrame:
        pairs = rows.select("id", "repeat").distinct().join(out.select("id", "repeat"), ["id", "repeat"], "left_anti")
        return grades.join(pairs, ["id", "repeat"], "left_semi")

    def summary(rows: DataFrame, out: DataFrame, grades: DataFrame) -> DataFrame:
        counts = {"requested_pairs": rows.select("id", "repeat").distinct(), "excluded_pairs": out, "judged_pairs": grades.select("id", "repeat").distinct()}
        found = summarize(grades)
        for name, table in counts.items():
            found = found.unionByName(table.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("metric"), F.lit(None).cast("string").alias("arm"), F.lit(None).cast("string").alias("dimension"), "value"))
        return found

    return [
        Stage("generated", ("cases", "answers"), generated, f"{reason}/{repeats}"),
        Stage("excluded", ("generated",), excluded),
        Stage("judged", ("generated", "excluded", "grades"), judged),
        Stage("summary", ("generated", "excluded", "judged"), summary),
    ]


def whole_summary(grades: DataFrame, style: DataFrame | None = None, distances: DataFrame | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """summarize(grades) with the means of style and distance by arm, and the limits of intervals, in the same long form.

    style and distances: (id, repeat, arm, measure, value), one row a measure of an answer; intervals: (dimension, mean, low, high) as the bootstraps give them.
    Measures take the place of dimensions. Without rows a part adds nothing.
    """
    found = summarize(grades)
    for metric, rows in (("style", style), ("distance_to_reference", distances)):
        if rows is not None:
            means = rows.groupBy("arm", "measure").agg(F.avg("value").alias("value"))
            found = found.unionByName(means.select(F.lit(metric).alias("metric"), "arm", F.col("measure").alias("dimension"), "value"))
    if intervals is not None:
        limits = intervals.select("dimension", F.col("low").alias("ci_low"), F.col("high").alias("ci_high")).unpivot("dimension", ["ci_low", "ci_high"], "metric", "value")
        found = found.unionByName(limits.select("metric", F.lit(None).cast("string").alias("arm"), "dimension", "value"))
    return found

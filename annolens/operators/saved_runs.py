"""Finished runs, read from their saved rows: summaries of each, of named combinations and of all; ladders; and the report that people read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolens.operators import ladder, runs
from annolens.operators.summary import ARMS, long_grades, markdown, summarize
from annolens.sources.study import json_table

#: A saved row: the grades of each judgment by arm and dimension, and what was measured of each arm's text.
ROWS = "id string, repeat int, judgments array<map<string,map<string,int>>>, judge map<string,map<string,int>>, invalid_judgments array<string>, measured map<string,struct<band:string,restatement:double,foreign_per_100:double>>"
ALL = "all"


def saved_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a run, one file each below `results`, in the order in which they are published."""
    return runs.in_order(json_table(spark, f"{folder.rstrip('/')}/results/*.json", ROWS), "results")


def labelled(rows: dict[str, DataFrame]) -> DataFrame:
    """The rows of all runs with `run`; equal ids of two runs stay apart by it."""
    every = None
    for name, part in rows.items():
        part = part.withColumns({"run": F.lit(name), "id": F.concat_ws(":", F.lit(name), F.col("id").cast("string"))})
        every = part if every is None else every.unionByName(part)
    if every is None:
        raise ValueError("no runs")
    return every


def pooled(rows: dict[str, DataFrame], combinations: dict[str, list[str]] | None = None) -> DataFrame:
    """(pool, metric, arm, dimension, value): summaries of each run, of each named combination of runs, and of all of them where there are several.

    A combination that names a run which is not there, or that has a run's name, is refused.
    """
    pools = {name: [name] for name in rows} | ({ALL: list(rows)} if len(rows) > 1 else {})
    for name, parts in (combinations or {}).items():
        if name in pools or not parts or (unknown := [p for p in parts if p not in rows]):
            raise ValueError(f"combination {name}: " + ("its name is taken" if name in pools else f"no run {', '.join(unknown)}" if parts else "it has no runs"))
        pools[name] = parts
    every = labelled(rows)
    found = None
    for name, parts in pools.items():
        mine = every.where(F.col("run").isin(*parts))
        counts = runs.judgment_counts(mine).select(*[F.col(c).cast("double") for c in ("valid_judgments", "invalid_judgments")])
        counts = counts.select(F.explode(F.create_map(*[x for c in counts.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
        null = F.lit(None).cast("string")
        part = summarize(long_grades(mine)).unionByName(counts.select("metric", null.alias("arm"), null.alias("dimension"), "value")).select(F.lit(name).alias("pool"), "metric", "arm", "dimension", "value")
        found = part if found is None else found.unionByName(part)
    return found


def ladders(rows: DataFrame, verdicts: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """(arm, rung, criterion, judged, passed, rate_of_standing, rate_of_all) of a run's generated arms; cases and verdicts as scored_rows() takes them."""
    measured = rows.select("id", "repeat", F.explode("measured").alias("arm", "m")).select("id", "repeat", "arm", "m.*")
    scored = runs.scored_rows(long_grades(rows), measured, verdicts, cases)
    found = None
    for arm in ARMS[:2]:
        part = ladder.standing(scored.where(F.col("arm") == arm), runs.LADDER).select(F.lit(arm).alias("arm"), "*")
        found = part if found is None else found.unionByName(part)
    return found


def paired_report(summary: DataFrame, title: str) -> Iterator[str]:
    """A summary as a Markdown report: mean grades by arm, then paired differences. Lower is better."""
    at = lambda metric, arm=None: F.round(F.max(F.when((F.col("metric") == metric) & (F.col("arm") == arm if arm else F.col("arm").isNull()), F.col("value"))), 3)
    by_dimension = summary.where("dimension is not null").groupBy("dimension")
    yield f"# {title}"
    yield ""
    yield "Grades are deficits: lower is better. These are descriptive results of paired answers, no statistical proof."
    yield ""
    yield from markdown(by_dimension.agg(*[at("mean_grade", a).alias(a) for a in ARMS]).orderBy("dimension"))
    yield ""
    paired = by_dimension.agg(*[at(m).alias(m) for m in ("mean_delta", "wins", "ties", "losses", "severe", "exact_agreement")])
    yield from markdown(paired.where("mean_delta is not null").orderBy("dimension"))

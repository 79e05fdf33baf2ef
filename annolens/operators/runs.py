"""Whole runs put together from the parts: scored rows, file series, funnels, attempts, the guide and the order of published results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.operators import ladder
from annolens.operators.contracts import DEFICITS, at, file_set_reason, items
from annolens.operators.matching import matched
from annolens.operators.summary import NOTICEABLE, criteria, long_grades, summarize, unit_means
from annolens.operators.validate import Check, first_reason

LADDER = ["clean", "effective", "invasive", "optimal"]
#: The order in which each kind of result is published.
ORDERS = {
    "results": ("id", "repeat"),
    "selection": ("split", "path", "line"),
    "placement": ("split", "kind", "path", "line"),
    "decisions": ("id", "arm"),
    "files": ("path", "arm"),
}
#: Bytes of sources that a change may come with.
CONTEXT_BYTES = 200_000


def in_order(rows: DataFrame, kind: str) -> DataFrame:
    return rows.orderBy(*ORDERS[kind])


def missing_cases(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows whose case is not in the corpus: what makes a run impossible to score. Empty if all is well."""
    return rows.join(cases.select("id"), "id", "left_anti")


def scored_rows(grades: DataFrame, measured: DataFrame, optimal: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Criteria of every answer, with the first that it fails; whether its meaning holds (`precondition`) stands beside them and gates nothing.

    With cases (id, path), an answer without a case ends the query, and verdicts of whole files (path, arm, passed) meet their file's answers.
    """
    rows = criteria(grades, measured, None if cases is not None else optimal)
    if cases is not None:
        rows = matched(rows, cases.select("id", "path"), ["id"], what="answer without a case")
        rows = rows.drop("optimal").join(optimal.select("path", "arm", F.col("passed").alias("optimal")), ["path", "arm"], "left") if optimal is not None else rows
    return rows.withColumn("first_failure", ladder.first_failure(LADDER))


def scored_run(grades: DataFrame, measured: DataFrame, arm: str, optimal: DataFrame | None = None) -> DataFrame:
    """The ladder of one arm."""
    return ladder.standing(scored_rows(grades, measured, optimal).where(F.col("arm") == arm), LADDER)


def reaggregated(valid: DataFrame, invalid: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(judgments that count, those that still do not): preserved invalid answers are validated again; no answer is asked for anew."""
    again = invalid.withColumn("reason", reason)
    return valid.unionByName(again.where("reason is null").select(*valid.columns)), again.where("reason is not null")


def judgment_counts(rows: DataFrame, valid: str = "judgments", invalid: str = "invalid_judgments") -> DataFrame:
    """(valid_judgments, invalid_judgments) over rows that hold arrays of either; null arrays hold none."""
    count = lambda c: F.coalesce(F.sum(F.greatest(F.size(F.col(c)), F.lit(0))), F.lit(0))
    return rows.agg(count(valid).alias("valid_judgments"), count(invalid).alias("invalid_judgments"))


def combined(runs: dict[str, DataFrame]) -> DataFrame:
    """Summaries of runs and of all of them together, tagged; a unit's id carries its run, so equal ids of two runs stay apart."""
    each = [rows.withColumn("id", F.concat_ws(":", F.lit(name), F.col("id").cast("string"))) for name, rows in runs.items()]
    every = each[0]
    for rows in each[1:]:
        every = every.unionByName(rows)
    out = summarize(every).withColumn("run", F.lit("combined"))
    for name, rows in runs.items():
        out = out.unionByName(summarize(rows).withColumn("run", F.lit(name)))
    return out


def judged_summary(rows: DataFrame) -> DataFrame:
    """The summary of rows that hold judgments as arrays, with the number of pairs; no rows give `pairs` 0 alone."""
    grades = long_grades(rows)
    pairs = unit_means(grades).where("arm <> 'upstream'").groupBy("id", "repeat").agg(F.count_distinct("arm").alias("arms")).agg(F.count_if(F.col("arms") == 2).cast("double").alias("value"))
    null = F.lit(None).cast("string")
    return summarize(grades).unionByName(pairs.select(F.lit("pairs").alias("metric"), null.alias("arm"), null.alias("dimension"), "value"))


def file_series(sets: DataFrame, answers: DataFrame, arms: list[str], label: str = "S1") -> tuple[DataFrame, DataFrame]:
    """(summary by arm, refused answers). sets: (path, arm, text) of files with enough comments; answers: (path, arm, answer).

    An arm without a valid answer keeps its row, with 0 files and null means.
    """
    rows = sets.join(answers, ["path", "arm"]).withColumn("texts", F.create_map(F.lit(label), F.col("text")))
    rows = rows.withColumn("reason", file_set_reason("answer", "texts"))
    first = F.get(items(F.col("answer"), "sets"), 0)
    valid = rows.where("reason is null").select("path", "arm", *[at(first, d).cast("int").alias(d) for d in DEFICITS])
    passed = F.count_if(F.greatest(*DEFICITS) < NOTICEABLE).alias("passed")
    found = valid.groupBy("arm").agg(F.count("*").alias("files"), passed, *[F.avg(d).alias(d) for d in DEFICITS])
    domain = sets.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
    return domain.join(found, "arm", "left").fillna(0, ["files", "passed"]), rows.where("reason is not null").select("path", "arm", "reason")


def commit_reasons(commits: DataFrame) -> DataFrame:
    """commits (parents, context_bytes, rejection, split_count) with the first reason why each is left out; null: kept."""
    checks: list[Check] = [
        ("merge", "parents <> 1"),
        ("not eligible", "rejection is not null"),
        ("files of several splits", "split_count > 1"),
        ("context too large", F.col("context_bytes") > CONTEXT_BYTES),
    ]
    return commits.withColumn("reason", first_reason(checks, None))


def cascade(rows: DataFrame, steps: list[str], group: str, mean: str) -> DataFrame:
    """(group, rows, one count a step, mean): rows that pass a step and all before it; the mean is over those that pass the first."""
    sums, so_far = [], F.lit(True)
    for name in steps:
        so_far = so_far & F.coalesce(F.col(name), F.lit(False))
        sums.append(F.count_if(so_far).alias(name))
    return rows.groupBy(group).agg(F.count("*").alias("rows"), *sums, F.avg(F.when(F.col(steps[0]), F.col(mean))).alias("mean"))


def public_answers(scored: DataFrame) -> DataFrame:
    """Scored changes as they are published: without the lines that they touch."""
    return scored.drop("touched_lines", "touched")


def latest_attempts(attempts: DataFrame, key: str, order: str, counts: list[str]) -> DataFrame:
    """The last attempt of each key; counts that its pruned artifacts no longer tell are those of the last attempt that did.

    Attempts are only appended, so a failed one is kept and never overwritten. One aggregation.
    """
    carried = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in counts]
    rest = [c for c in attempts.columns if c not in (key, order, *counts)]
    return attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest], *carried)


def guide(rules: DataFrame, key: str, parts: list[str], title: str = "Guide") -> DataFrame:
    """(text, sha256): the guide that a table of rules makes, in the order of their ids, and its fingerprint.

    A guide is read as a whole by people and by models, so its rules are few; a saved guide is stale if its fingerprint is another.
    """
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col(key).cast("string")), *parts)
    joined = rules.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), body.alias("b")))), lambda r: r["b"]), "\n\n").alias("body"))
    return joined.select(F.concat(F.lit(f"# {title}\n\n"), "body").alias("text")).withColumn("sha256", F.sha2("text", 256))


"""The command line: python -m annolens queries | run NAME FOLDER [--out PATH] | review CHANGE ANSWER | summarize --run LABEL=FOLDER... | score --run FOLDER | select POOL --out PATH.

Results go to standard output as JSON, one object a line. What a user can get wrong ends with its reason on standard error and exit code 1.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens import catalog
from annolens.operators import saved_runs
from annolens.operators.contracts import change_reason, review_reason, review_statuses
from annolens.operators.runs import in_order
from annolens.operators.selection import select_stratified
from annolens.session import session, ship
from annolens.sources.study import write_once

#: Rows of a result that are printed; a larger one must be written.
SHOWN = 10_000


def _print(rows: DataFrame) -> None:
    found = rows.select(F.to_json(F.struct(*rows.columns))).limit(SHOWN + 1).collect()
    if len(found) > SHOWN:
        raise ValueError(f"more than {SHOWN} rows: write them with --out")
    for r in found:
        print(r[0])


def _run(args: argparse.Namespace) -> None:
    if args.name not in catalog.QUERIES:
        raise ValueError(f"no query named {args.name}")
    spark = session()
    ship(spark)
    rows = catalog.QUERIES[args.name](spark, args.folder)
    write_once(rows, args.out) if args.out else _print(rows)


def _review(args: argparse.Namespace) -> None:
    texts = [Path(p).read_text(encoding="utf-8") for p in (args.change, args.answer)]
    rows = session().createDataFrame([(0, *texts)], "review int, change string, answer string")
    checked = rows.select("*", change_reason("change").alias("input"), review_reason("answer", "change").alias("answered")).first()
    if problem := checked["input"] or checked["answered"]:
        raise ValueError(problem)
    _print(review_statuses(rows, "review", "answer", "change").drop("review"))


def _pairs(values: list[str], what: str) -> dict[str, str]:
    """LABEL=VALUE arguments; each label once."""
    found: dict[str, str] = {}
    for text in values:
        name, sign, value = text.partition("=")
        if not (name and sign and value) or name in found:
            raise ValueError(f"{what} {text}: LABEL=VALUE is asked for, each label once")
        found[name] = value
    return found


def _summarize(args: argparse.Namespace) -> None:
    spark = session()
    rows = {name: saved_runs.saved_rows(spark, folder) for name, folder in _pairs(args.run, "--run").items()}
    combinations = {name: parts.split(",") for name, parts in _pairs(args.combine, "--combine").items()}
    found = saved_runs.pooled(rows, combinations)
    if args.report:
        for pool in [*rows, *combinations, *([saved_runs.ALL] if len(rows) > 1 else [])]:
            print("\n".join(saved_runs.paired_report(found.where(F.col("pool") == pool), pool)), end="\n\n")
    else:
        _print(found.orderBy("pool", "metric", "arm", "dimension"))


def _score(args: argparse.Namespace) -> None:
    _print(saved_runs.ladders(saved_runs.saved_rows(session(), args.run)).orderBy("arm", "rung"))


def _select(args: argparse.Namespace) -> None:
    spark = session()
    ship(spark)
    totals = {name: int(n) for name, n in _pairs(args.total, "--total").items()}
    rows = select_stratified(spark.read.parquet(args.pool), totals, pool=["path", "line"], cap=args.cap)
    write_once(in_order(rows, "selection"), args.out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="annolens")
    todo = parser.add_subparsers(required=True)
    todo.add_parser("queries", help="names of all queries").set_defaults(act=lambda args: print("\n".join(sorted(catalog.QUERIES))))
    run = todo.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("--out", help="a new folder for the result, as Parquet")
    run.set_defaults(act=_run)
    review = todo.add_parser("review", help="check and summarise a review of a change")
    review.add_argument("change")
    review.add_argument("answer")
    review.set_defaults(act=_review)
    summary = todo.add_parser("summarize", help="summarize finished runs, combinations of them and all together")
    summary.add_argument("--run", action="append", required=True, metavar="LABEL=FOLDER")
    summary.add_argument("--combine", action="append", default=[], metavar="LABEL=A,B")
    summary.add_argument("--report", action="store_true", help="Markdown in place of JSON lines")
    summary.set_defaults(act=_summarize)
    score = todo.add_parser("score", help="the ladder of a finished run")
    score.add_argument("--run", required=True, metavar="FOLDER")
    score.set_defaults(act=_score)
    select = todo.add_parser("select", help="freeze a stratified sample of a Parquet pool (split, path, line, band, kind, sha)")
    select.add_argument("pool")
    select.add_argument("--total", action="append", required=True, metavar="SPLIT=N")
    select.add_argument("--cap", type=int, default=6, help="rows a path may have")
    select.add_argument("--out", required=True)
    select.set_defaults(act=_select)
    args = parser.parse_args(argv)
    try:
        args.act(args)
    except (ValueError, OSError, PySparkException) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

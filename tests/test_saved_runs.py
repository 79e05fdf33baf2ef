"""Finished runs through files and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException

from annolens.__main__ import main
from annolens.operators import saved_runs, summary
from annolens.session import ship
from annolens.sources import results
from tests.test_runs import pool_of


def rows_of(spark, better):
    def grades(shift):
        return {a: {d: (k + shift) % 3 + (a != "with_spec") * better for k, d in enumerate(summary.DIMENSIONS)} for a in summary.ARMS}

    measured = {a: ("short", 0.1, 0.0) for a in summary.ARMS}
    return spark.createDataFrame([(f"c{k}", 0, [grades(k), grades(k + 1)], None, ["bad"] * (k % 2), measured) for k in range(4)], saved_runs.ROWS)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    ship(spark)
    root = tmp_path_factory.mktemp("runs")
    for name, better in (("a", 1), ("b", 0)):
        (root / name).mkdir()
        results.write_results(rows_of(spark, better), str(root / name / "results"))
    return root


def test_runs_are_summarized_alone_and_together(folders, capsys):
    runs = ["--run", f"a={folders}/a", "--run", f"b={folders}/b"]
    assert main(["summarize", *runs, "--combine", "both=a,b", "--combine", "one=b"]) == 0
    got = {(r["pool"], r["metric"], r.get("arm"), r.get("dimension")): r["value"] for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert {p for p, *_ in got} == {"a", "b", "all", "both", "one"}
    deltas = {p: got[p, "mean_delta", None, "words"] for p in ("a", "b", "all", "both", "one")}
    assert deltas == {"a": -1, "b": 0, "all": -0.5, "both": -0.5, "one": 0}
    assert got["a", "valid_judgments", None, None] == 8 and got["all", "invalid_judgments", None, None] == 4 and got["all", "wins", None, "words"] == 4
    assert main(["summarize", *runs, "--report"]) == 0
    text = capsys.readouterr().out
    assert text.count("# ") == 3 and "| words |" in text and "| dimension | without_spec | with_spec | upstream |" in text


def test_bad_labels_are_refused(folders, capsys):
    run = f"a={folders}/a"
    for args in (["--run", "a"], ["--run", run, "--run", run], ["--run", run, "--combine", "x=a,z"], ["--run", run, "--combine", "a=a"]):
        assert main(["summarize", *args]) == 1 and capsys.readouterr().err


def test_a_run_is_scored(folders, capsys):
    assert main(["score", "--run", f"{folders}/a"]) == 0
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["arm"], r["criterion"]) for r in got] == [(a, c) for a in sorted(summary.ARMS[:2]) for c in ("clean", "effective", "invasive", "optimal")]
    assert got[0]["judged"] == 4 and got[0]["arm"] == "with_spec"


def test_a_sample_is_frozen_once(spark, tmp_path, capsys):
    spark.createDataFrame(pool_of(1)).write.parquet(str(tmp_path / "pool"))
    args = ["select", str(tmp_path / "pool"), "--total", "a=14", "--total", "b=9", "--cap", "3", "--out", str(tmp_path / "sample")]
    assert main(args) == 0
    got = [(r.split, r.path, r.line) for r in spark.read.parquet(str(tmp_path / "sample")).collect()]
    assert len(got) == 23 and got == sorted(got)
    assert main(args) == 1 and "already exists" in capsys.readouterr().err


def test_no_runs_no_summary(spark):
    with pytest.raises(ValueError):
        saved_runs.pooled({})
    with pytest.raises(PySparkException):
        saved_runs.saved_rows(spark, "/nowhere").count()

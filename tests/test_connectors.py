"""The paged listing, the sink of one file a row and the stream of call logs, through Spark."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from annolens.operators.contracts import call_reasons
from annolens.session import ship
from annolens.sources import pages, results, study
from annolens.streaming import calls


def saved_pages(folder, sizes, first=0):
    folder.mkdir(parents=True)
    for k, n in enumerate(sizes, 1):
        (folder / f"page-{k}.json").write_text(json.dumps([{"sha": f"c{first + i}", "note": "é"} for i in range(n)]))
        first += n
    return str(folder)


@pytest.mark.parametrize("sizes", [[1] * 12, [5, 5, 2], [12], [4, 4, 4, 0]])
def test_a_listing_is_the_same_whatever_its_pages(spark, tmp_path, sizes):
    ship(spark)
    folder = saved_pages(tmp_path / "p", sizes)
    for scan in (1, 7, 12, 40):
        rows = pages.listing(spark, folder, scan, per_page=min(sizes[:-1] or sizes)).collect()
        assert sorted((r.position, json.loads(r.entry)["sha"]) for r in rows) == [(k + 1, f"c{k}") for k in range(min(scan, 12))]


def test_a_listing_ends_with_an_empty_page_and_names_bad_ones(spark, tmp_path):
    folder = saved_pages(tmp_path / "p", [2, 0, 2])
    assert pages.listing(spark, folder, 100, per_page=2).count() == 2
    assert pages.listing(spark, f"file://{folder}", 100, per_page=2).count() == 2
    assert pages.listing(spark, str(tmp_path / "none"), 10).count() == 0
    for bad in ("{", '{"a": 1}', "[1]"):
        (tmp_path / "p/page-2.json").write_text(bad)
        with pytest.raises(PySparkException, match="page-2.json is no"):
            pages.listing(spark, folder, 100, per_page=2).count()
    with pytest.raises(ValueError):
        pages.listing(spark, folder, 0)


def test_pages_are_read_once(spark, tmp_path):
    """Each page is its own partition, and the listing's later steps read the table that they went to."""
    folder = saved_pages(tmp_path / "p", [3, 3, 1])
    spark.dataSource.register(pages.Pages)
    raw = spark.read.format(pages.FORMAT).option("path", folder).option("pages", 3).load()
    assert raw.rdd.getNumPartitions() == 3 and {r.n for r in raw.groupBy(F.spark_partition_id()).agg(F.count_distinct("page").alias("n")).collect()} == {1}
    rows = pages.listing(spark, folder, 7, per_page=3)
    for k in (1, 2, 3):
        (tmp_path / f"p/page-{k}.json").unlink()
    assert rows.count() == 7


def test_results_are_one_file_a_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{k}", k % 2, {"words": k}, "é\n" * k) for k in range(30)], "id string, repeat int, grades map<string,int>, text string").repartition(4)
    target = tmp_path / "results"
    results.write_results(rows, str(target))
    found = {p.name: p.read_text() for p in target.iterdir()}
    assert set(found) == {f"c{k}-{k % 2}.json" for k in range(30)} and not list(tmp_path.glob(".*"))
    assert found["c3-1.json"] == '{\n  "id": "c3",\n  "repeat": 1,\n  "grades": {\n    "words": 3\n  },\n  "text": "é\\né\\né\\n"\n}\n'
    back = study.json_table(spark, f"{target}/*.json", "id string, repeat int, grades map<string,int>, text string")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(Exception, match="exists already"):
        results.write_results(rows, str(target))
    assert {p.name: p.read_text() for p in target.iterdir()} == found


def test_results_that_fail_leave_nothing(spark, tmp_path):
    good = spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("repeat"))
    cases = {
        "broken": good.where(F.when(F.col("id") == "7", F.raise_error(F.lit("broken task")).cast("boolean")).otherwise(True)),
        "names": good.unionByName(good.limit(1)),
        "would be": good.withColumn("x", F.lit(1)).unionByName(good.limit(1).withColumn("x", F.lit(2))),
        "no file name": good.unionByName(good.limit(1).withColumn("id", F.lit("../up"))),
    }
    for said, rows in cases.items():
        with pytest.raises(Exception, match=said):
            results.write_results(rows, str(tmp_path / "r"))
        assert list(tmp_path.iterdir()) == []
    results.write_results(good, str(tmp_path / "r"))
    assert len(list((tmp_path / "r").iterdir())) == 20


def test_a_task_that_is_killed_and_run_again(spark, tmp_path):
    rows = [r for r in spark.createDataFrame([(f"c{k}", 0) for k in range(9)], "id string, repeat int").collect()]
    writer = results.ResultWriter(str(tmp_path / "r"), ["id", "repeat"])

    def dies():
        yield from rows[:4]
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    assert not (tmp_path / "r").exists()
    writer.commit([writer.write(iter(rows[:5])), writer.write(iter(rows[5:]))])
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == [f"c{k}-0.json" for k in range(9)]


START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def logs():
    """Events of calls that end well, end badly, hold tools before and after a failure, start twice or never end."""
    kinds = {
        "sound": [("thread.started", None), ("item.completed", "agent_message"), ("item.completed", "reasoning"), ("turn.completed", None)],
        "failed": [("thread.started", None), ("turn.failed", None), ("item.completed", "command"), ("turn.completed", None)],
        "tool": [("thread.started", None), ("item.completed", "command"), ("error", None), ("turn.completed", None)],
        "twice": [("thread.started", None), ("thread.started", None), ("error", None), ("turn.completed", None)],
        "open": [("thread.started", None), ("item.completed", "agent_message")],
    }
    return [
        {"call": f"{kind}{n}", "seq": seq, "at": (START + timedelta(minutes=3 * n + seq)).isoformat(), "event": event, "item": item}
        for kind, events in kinds.items() for n in range(4) for seq, (event, item) in enumerate(events)
    ]


def test_call_logs_stream_and_resume(spark, tmp_path):
    ship(spark)
    events = logs()
    random.Random(3).shuffle(events)
    end = [{"call": "later", "seq": 0, "at": (START + timedelta(days=k)).isoformat(), "event": "thread.started", "item": None} for k in (1, 2)]
    parts = [events[k::4] for k in range(4)] + [end]

    def put(folder, k):
        folder.mkdir(exist_ok=True)
        (folder / f"{k}.jsonl").write_text("\n".join(map(json.dumps, parts[k])))

    def verdicts(out):
        return sorted((r.call, r.threads, r.turns, r.reason) for r in spark.read.schema(calls.VERDICTS).parquet(str(out)).collect())

    run = lambda name: calls.judge_calls(spark, str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state"), patience=timedelta(hours=2), late="3 hours", files_a_batch=2)
    for k in range(5):
        put(tmp_path / "one-in", k)
    run("one")
    for k in range(5):
        put(tmp_path / "two-in", k)
        if k in (1, 2, 4):
            run("two")
    run("two")
    got = verdicts(tmp_path / "one-out")
    assert got == verdicts(tmp_path / "two-out")
    batch = study.json_lines(spark, str(tmp_path / "one-in"), calls.EVENTS)
    want = {r.call: r.reason for r in call_reasons(batch, "call", "event", "item", "seq").collect() if r.call != "later"}
    assert {c: reason for c, _, _, reason in got if c != "later"} == want
    assert {c.rstrip("0123"): reason for c, reason in want.items()} == {"sound": None, "failed": "failed turn", "tool": "tool use", "twice": "no unique thread or completed turn", "open": "no unique thread or completed turn"}

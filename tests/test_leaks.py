"""Leaks and resamples against brute force."""

from __future__ import annotations

import random

import pytest

from annolens.operators import leaks, sampling


def test_leaks_are_those_of_a_search(spark):
    """Lines of one word to many, cut words at both ends, wide gaps, odd white space; with keys broadcast and shuffled."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    gap = " " * 40
    lines = [word(40), word(31), word(20) + " " + word(20), word(3) + " " + word(30), word(30) + " " + word(2), "ab" + gap + "c", word(9) + "\t" + word(9) + gap + word(9), " ".join(word(6) for _ in range(5)), " ".join(word(5) for _ in range(9)), "  " + word(35) + "\t", "short line", "  " * 20]
    items = [(k % 5, line) for k, line in enumerate(lines)] + [(9, "\n".join(lines[:4])), (8, None), (7, "")]
    docs = [(0, None), (1, "")]
    for k in range(120):
        held = [x for x in lines if r.random() < 0.25]
        text = " ".join(x for line in held for x in (word(4), r.choice(["x", "", " "]) + line.replace(" ", r.choice([" ", "  ", "\n"])) + r.choice(["y", "", "\n"]), word(3)))
        docs.append((k + 2 if k % 10 else 2, text))
    squeeze = lambda t: " ".join(t.split())
    want = {}
    for d, text in docs:
        for i, body in items:
            for line in (body or "").split("\n"):
                if len(line.strip()) > 30 and squeeze(line) in squeeze(text or ""):
                    want.setdefault((d, i), set()).add(squeeze(line))
    frames = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    for most in (leaks.MOST_KEYS, 2):
        got = {(x.doc_id, x.item_id): x.lines for x in leaks.leaks(*frames, most_keys=most).collect()}
        assert got == {k: len(v) for k, v in want.items()} and len(got) > 100
    assert leaks.leaks(frames[0], frames[1].limit(0)).count() == 0 and leaks.leaks(frames[0].limit(0), frames[1]).count() == 0


@pytest.mark.parametrize("kind", ["broadcast", "shuffled"])
def test_bootstrap_forms_agree(spark, kind):
    rows = spark.createDataFrame([(k, None if k == 5 else float(k % 7)) for k in range(50)], "k int, v double")
    got = sampling.hash_bootstrap(rows, "v", "k", 40, 1, most_values=0 if kind == "shuffled" else 100).first()
    assert got == sampling.hash_bootstrap(rows.repartition(3), "v", "k", 40, 1).first() and got.low < got.mean < got.high
    assert tuple(sampling.hash_bootstrap(rows.limit(0), "v", "k", 40, 1).first()) == (0.0, 0.0, 0.0)


def test_poisson_resamples_cover_the_mean(spark):
    rows = spark.range(4000).selectExpr("id", "cast(id % 10 as double) as v")
    got = sampling.poisson_bootstrap(rows, "v", "id", 60, 3).first()
    spread = (got.high - got.low) / 3.7
    assert got.mean == 4.5 and got.low < 4.5 < got.high and 0.6 < spread / (8.25 / 4000) ** 0.5 < 1.5
    assert tuple(sampling.poisson_bootstrap(rows.limit(0), "v", "id", 20, 3).first()) == (0.0, 0.0, 0.0)

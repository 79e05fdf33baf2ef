"""Resampling, quality rules and collocations against brute force, SQL and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from annolens.llm import collocations, crc, quality_rules, resample
from annolens.llm.queries import ORACLE, QUERIES
from tests.conftest import DATA, plain
from tests.llm.test_operators import ODD, docs_of, lower


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return words, [w.encode() for w in words] + [f"{a} {b}".encode() for a, b in zip(words, words[1:], strict=False)]


def slow_resample(rows, target, percent=25, least=20):
    """{(doc_id, n_features, weight, score, rank)} as the contract says it."""
    bucket = lambda f: zlib.crc32(f) % 10000
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    g = Counter(bucket(f) for t in target for f in features(t)[1])
    all_s, all_g = sum(s.values()), sum(g.values())
    gain = lambda b: math.floor(1000 * math.log((g[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_g + 10000))))
    found = []
    for i, t in rows:
        words, fs = features(t)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    eligible = sorted((r for r in found if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = eligible[: percent * len(eligible) // 100]
    ranked = [(*r[:4], k + 1) for k, r in enumerate(drawn)]
    left = list(found)
    for r in drawn:
        left.remove(r)
    return sorted([*ranked, *[(*r[:4], None) for r in left]], key=repr)


def test_run_hashes_are_crc32():
    random.seed(1)
    known = [random.randbytes(n) for n in (0, 1, 2, 3, 62, 63, 64, 65, 200, 70_000)]
    words, tokens = crc.Words(), random.choices(known, k=400)
    numbers = words.numbers(tokens)
    run = words.first(numbers)
    for k in range(1, 5):
        assert run.tolist() == [zlib.crc32(b" ".join(tokens[i : i + k])) for i in range(len(tokens) - k + 1)]
        run = words.joined(run[:-1], numbers[k:])


def test_tournament_merges_sorted_runs():
    random.seed(2)
    tree, want, got = resample.Tournament(), [], []
    for k in range(37):
        run = sorted(random.randrange(50) for _ in range(random.randrange(9)))
        want += run
        tree.add(iter([((x,), (x, k)) for x in run]))
    while tree.winner:
        got.append(tree.pop()[0])
    assert got == sorted(want)


@pytest.mark.parametrize("least_range", [4, 1024])
def test_resample_is_brute_force(spark, documents, texts, least_range):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = resample.resample(documents.repartition(5), target, least_range=least_range).collect()
    want = slow_resample(list(texts.items()), [r.text for r in target.collect()])
    assert sorted((tuple(r) for r in got), key=repr) == want and any(r.rank for r in got)


def test_resample_odd_rows(spark):
    words = [" ".join(f"w{(i * j) % 7}" for j in range(25)) for i in range(40)]
    rows = ODD + [(100 + i, t) for i, t in enumerate(words)] + [(100, words[0])] * 9 + [(None, words[1])] * 2
    for target in ([], [None, "", "w1 w2 w3 word"]):
        got = resample.resample(docs_of(spark, rows), docs_of(spark, [(0, t) for t in target]), least_range=2)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == slow_resample(rows, target)
    assert resample.resample(docs_of(spark, []), docs_of(spark, [])).count() == 0
    assert [r.rank for r in resample.resample(docs_of(spark, [(1, "too short")]), docs_of(spark, [])).collect()] == [None]


@pytest.mark.parametrize("name", ["op11_resample", "op12_quality_rules", "op13_collocations"])
def test_queries_match_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def slow_rates(rows):
    """{host: highest shrunk rate} of (host, measures)."""
    rules = [lambda m: m[0] < 50, lambda m: 100 * m[4] > 50 * m[0], lambda m: 10 * m[2] > m[0], lambda m: m[1] < 2 * m[0] or m[1] > 12 * m[0], lambda m: 100 * m[3] > 30 * m[5]]
    hosts = {h for h, _ in rows if h is not None}
    best = dict.fromkeys(hosts, 0.0)
    for rule in rules:
        n = {h: sum(x == h for x, _ in rows) for h in hosts}
        f = {h: sum(x == h and rule(m) for x, m in rows) for h in hosts}
        docs, p = sum(n.values()), Fraction(sum(f.values()), max(1, sum(n.values())))
        chance, room = p * (1 - p), docs - Fraction(sum(x * x for x in n.values()), max(1, docs)) - (len(hosts) - 1)
        strength = Fraction(2)
        if chance > 0 and room > 0:
            rho = (sum(n[h] * (Fraction(f[h], n[h]) - p) ** 2 for h in hosts) - chance * (len(hosts) - 1)) / (chance * room)
            rho = min(max(rho, Fraction(1, 1_000_001)), Fraction(1))
            strength = (1 - rho) / rho
        for h in hosts:
            best[h] = max(best[h], float((f[h] + p * strength) / (n[h] + strength)))
    return best


def test_quality_rules_are_brute_force(spark):
    random.seed(5)
    good = lambda: " ".join(f"word{random.randrange(10**6)}" for _ in range(60))
    bad = lambda: random.choice(["too short", "a b c " * 40, "# " * 60, "same line here\n" * 20])
    shares = {"fine": (40, 0.05), "mixed": (40, 0.4), "foul": (40, 0.95), "small": (2, 1.0), "": (5, 0.0), None: (9, 0.7)}
    rows = [(None if k % 19 == 0 else k, bad() if random.random() < p else good(), h) for h, (n, p) in shares.items() for k in range(n)]
    rows += [(i, t, "odd") for i, t in ODD] + [(1, "a\x00b \x1c\x85 é ü\n\n \n\x0b\nx\r\nx\r\n" * 2, "odd")] + [(2, "same row", "odd")] * 3
    docs = spark.createDataFrame([(i, t, h, True, 1.0) for i, t, h in rows], "doc_id long, text string, source string, kept boolean, host_rate double")
    rates = slow_rates([(h, slow_measures(t)) for _, t, h in rows])
    want = []
    for i, t, h in rows:
        m = slow_measures(t)
        failed, rate = m[0] < 50 or 100 * m[4] > 50 * m[0], rates.get(h)
        rejected = rate is not None and rate > 0.5
        want.append((i, *m[:5], failed, not failed and not rejected, rejected, None if rate is None else round(rate, 6)))
    got = quality_rules.quality_rules(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {h for h, r in rates.items() if r > 0.5} == {"foul", "odd"} | {h for h in ("small",) if rates[h] > 0.5}
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_quality_rules_run_no_python(spark, documents):
    rows = quality_rules.measured(documents)
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()


def test_hosts_may_be_those_of_urls(spark):
    docs = spark.createDataFrame([(k, "short", f"http://{'ab'[k % 2]}.org/{k}") for k in range(6)], "doc_id long, text string, url string")
    from pyspark.sql import functions as F

    verdicts = quality_rules.host_verdicts(quality_rules.measured(docs, host=F.expr("parse_url(url, 'HOST')")))
    assert {(r.host, r.docs, r.failures["short"], r.rejected) for r in verdicts.collect()} == {("a.org", 3, 3, True), ("b.org", 3, 3, True)}


def slow_collocations(rows, least, share, top):
    """The contract's rows of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in candidates.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                part = (lang, p[i : i + size])
                if part in candidates and 100 * a >= share * candidates[part]:
                    dropped.add(part)
    found = []
    for (lang, p), a in candidates.items():
        if (lang, p) not in dropped:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((lang, -score, -a, " ".join(p).encode(), l, r))
    out = []
    for lang in sorted(n):
        best = sorted(x for x in found if x[0] == lang)[:top]
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -score) for k, (_, score, a, p, l, r) in enumerate(best)]
    return out


@pytest.mark.parametrize("least, top, slots, block", [(3, 2000, None, 1 << 20), (2, 40, 256, 500)])
def test_collocations_are_brute_force(spark, documents, least, top, slots, block):
    """Also with a bitmap in which nearly every bit is set, and with blocks that cut the corpus."""
    rows = [(r.text, r.lang) for r in documents.select("text", "lang").collect()][:60]
    rows += [("One two. three four five one two\tthree", None), (None, "en"), ("", None), ("a a a a a a. a a\x0ba", "en"), ("é ü É\x00x \x1c é ü", "und"), ("x" * 300 + " tail " + "x" * 300 + " tail", None)] * 4
    docs = spark.createDataFrame([(t, g, 1, 2) for t, g in rows], "text string, lang string, n int, phrase int").repartition(3)
    got = collocations.collocations(docs, least=least, top=top, slots=slots, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(slow_collocations(rows, least, 80, top))


def test_a_block_asks_for_its_distinct_words_only(monkeypatch):
    """A block's words are told apart in Arrow; Python hashes each distinct one once, and none to count words."""
    asked = []
    monkeypatch.setattr(crc.Words, "numbers", lambda self, words, numbers=crc.Words.numbers: asked.append(len(words)) or numbers(self, words))
    words = [b"a", b"b", b"c", b"."] * 500 + [b"a", b"b", b"."]
    block, bits = (["en", "de"], words, np.repeat([0, 1], [2000, 3])), np.full(1 << 17, 255, np.uint8)
    rows = lambda k: Counter({(r["lang"], r["phrase"]): r["n"] for r in collocations._counted(block, crc.Words(), k, bits if k > 1 else None).to_pylist()})
    assert rows(1) == Counter({("en", "a"): 500, ("en", "b"): 500, ("en", "c"): 500, ("de", "a"): 1, ("de", "b"): 1}) and asked == []
    assert rows(2) == Counter({("en", "a b"): 500, ("en", "b c"): 500, ("de", "a b"): 1})
    assert rows(3) == Counter({("en", "a b c"): 500}) and asked == [4, 4]


def test_collocations_odd_rows(spark, odd_docs):
    assert collocations.collocations(odd_docs).count() == len(slow_collocations([(t, "en") for _, t in ODD], 30, 80, 2000))
    assert collocations.collocations(odd_docs.limit(0)).count() == 0


def test_scores_pass_64_bits(spark):
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "a b", 2, big)], "lang string, phrase string, k int, n long")
    assert [tuple(r) for r in collocations.scored_cuts(counts.where("k > 1"), counts).collect()] == [("en", "a b", big, big + 7, big + 9, 2_000_000 * big // (2 * big + 16))]


@pytest.fixture(scope="module")
def odd_docs(spark):
    return docs_of(spark, ODD)

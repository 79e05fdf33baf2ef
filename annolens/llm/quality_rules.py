"""Quality rules of documents and of their hosts, with DataFrame functions alone.

Each text is measured where it is read, and each rule fails or holds. Failures are counted by host on the map side, so a host that holds a third of all rows
moves one partial row a task. A host's failure rate under each rule is shrunk towards the rate of all hosts: a beta prior, whose strength follows from how
much hosts differ beyond chance (moments of the beta-binomial, from sums over hosts), counts as so many more documents. A host whose shrunk rate under any
rule is over the limit is rejected, and its verdict is joined back to its documents; both sides of that join are tables, so Spark can
split a large host or broadcast a host table that it has measured to be small.

Words found twice by 64-bit hashes of three-word windows: two windows of one text differ under one hash in fewer than one of ten billion texts of a million words.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from annolens.llm.base import materialize

# What separates words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Hosts with a shrunk failure rate over this are rejected.
LIMIT = 0.5
#: Documents that a prior counts as: where all hosts fail alike, and where there is nothing to tell it from.
MOST_STRENGTH, PLAIN_STRENGTH = 1e6, 2.0

#: Rules by name: true where a document fails. The first two are the base rules, which reject a document by themselves.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repetitive")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(sorted_: Column) -> Column:
    """How many words stand in windows that are found twice or more. sorted_: (hash, place) of all windows, in order."""
    twin = F.filter(sorted_, lambda x, i: F.coalesce(x["h"] == F.get(sorted_, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(sorted_, i + 1)["h"], F.lit(False)))
    places = F.array_sort(F.transform(twin, lambda x: x["i"]))
    # Each place adds the words that the one before does not cover.
    added = F.transform(F.array(places), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(p, i - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda s, x: s + x))
    return F.get(added, 0)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines): whole texts, null as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.col(host) if isinstance(host, str) else host).alias("host"), text.alias("text"))
    rows = rows.withColumns({"words": F.filter(F.split("text", SPACE), lambda w: w != ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # A select of its own for each value that the next one uses more than once: computed once a row.
    at = lambda i: F.get("words", i)
    rows = rows.withColumn("windows", F.transform(F.slice("words", 1, F.greatest(F.lit(0), F.size("words") - 2)), lambda w, i: F.xxhash64(w, at(i + 1), at(i + 2))))
    alike = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.withColumn("placed", F.when(alike, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    return rows.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("placed") > 0, _repeated(F.col("placed"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def beta_prior(sums: Row | Mapping[str, float], rule: str) -> tuple[float, float]:
    """(alpha, beta) from sums over hosts: hosts, docs, docs2 (of squares), and of the rule its failures and failures squared a document."""
    hosts, docs, failures = sums["hosts"], sums["docs"] or 0, sums[f"f_{rule}"] or 0
    mean = failures / docs if docs else 0.0
    chance = mean * (1 - mean)
    spread, room = (sums[f"q_{rule}"] or 0.0) - failures * mean, (docs - sums["docs2"] / docs - (hosts - 1)) if docs else 0.0
    if chance <= 0 or room <= 0:
        strength = PLAIN_STRENGTH
    else:
        alike = min(max((spread - chance * (hosts - 1)) / (chance * room), 1 / (1 + MOST_STRENGTH)), 1.0)
        strength = (1 - alike) / alike
    return mean * strength, (1 - mean) * strength


def host_verdicts(rows: DataFrame, rules: dict[str, str] = RULES, limit: float = LIMIT) -> DataFrame:
    """(host, docs, failures map, rates map, host_rate, rejected) from measured rows. Rows without a host take no part."""
    counts = [F.count_if(F.expr(test)).alias(f"f_{name}") for name, test in rules.items()]
    hosts = materialize(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("docs"), *counts), "rule-hosts")
    # One row, whatever the number of hosts.
    part = [x for n in rules for x in (F.sum(f"f_{n}").alias(f"f_{n}"), F.sum(F.col(f"f_{n}").cast("double") * F.col(f"f_{n}") / F.col("docs")).alias(f"q_{n}"))]
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("docs").alias("docs"), F.sum(F.col("docs").cast("double") * F.col("docs")).alias("docs2"), *part).first()
    rates = {n: (F.col(f"f_{n}") + F.lit(a)) / (F.col("docs") + F.lit(a + b)) for n in rules for a, b in [beta_prior(sums, n)]}
    named = lambda values: F.create_map(*[x for n, v in values.items() for x in (F.lit(n), v)])
    found = hosts.select("host", "docs", named({n: F.col(f"f_{n}") for n in rules}).alias("failures"), named(rates).alias("rates"))
    return found.withColumn("host_rate", F.array_max(F.map_values("rates"))).withColumn("rejected", F.col("host_rate") > limit)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", *, rules: dict[str, str] | None = None, base: tuple[str, ...] = BASE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rejected, host_rate), one row for each input row.

    A document is kept if no base rule fails and its host is not rejected. A null text is an empty one: no words, so it fails the base rules. A document without
    a host is judged by the base rules alone (host_rejected false, host_rate null). Repeated rows count as often as they stand. An empty table
    gives an empty result. Other columns are ignored; `host` may be an expression, such as the host of a URL.
    """
    rules = rules or RULES
    rows = materialize(measured(docs, id_col, text_col, host), "rule-rows")
    verdicts = materialize(host_verdicts(rows, rules, limit).select(F.col("host").alias("of"), "host_rate", "rejected"), "rule-verdicts")
    failed = F.expr(" OR ".join(f"({rules[n]})" for n in base))
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    joined = rows.withColumn("base_failed", failed).join(verdicts, F.col("host") == F.col("of"), "left")
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), rejected.alias("host_rejected"), F.round("host_rate", 6).alias("host_rate"))

"""Which documents hold a whole line of which item, without comparing documents with lines they share nothing with.

A line's key is a piece of it that any text holding the line has whole: five words from its second on, or the longest of its inner words, or, where a line has one or two
words, a run of characters whose place in its word is known. Every document offers the keys of all kinds that it has. The lines' keys are counted; up to a
bound they are broadcast, so the documents' own keys are tested where they are made and only hits are shuffled; beyond it both sides are. `contains` decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.functions.text import SPACE, normalise
from annolens.session import pinned

#: Keys of lines that are broadcast, 16 bytes each; more go through a shuffle.
MOST_KEYS = 4_000_000
#: Characters of a line that counts, and of the pieces of lines of one or two words: one of two words has that many, and so has the line.
LONG, HALF = 30, 15
FIVE = 5


# Kinds of keys: five words, a whole word, the start and the end of a word, a run inside a word, the letters on both sides of a space.
WINDOW, WORD, START, END, INSIDE, BORDER = range(1, 7)


def _key(kind: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(kind), *parts)


def _line_key(words: Column) -> Column:
    """(kind, key) of a line. A line of two words that is short but for the space between them has no long word."""
    n = F.size(words)
    inner = F.slice(words, 2, F.greatest(F.lit(0), n - 2))
    longest = F.get(F.array_sort(inner, lambda a, b: F.length(b) - F.length(a)), 0)
    first, second = F.get(words, 0), F.get(words, 1)
    tail = lambda w, n: F.right(w, F.lit(n))
    choices = [
        (n >= FIVE + 2, WINDOW, [F.get(words, k) for k in range(1, FIVE + 1)]), (n >= 3, WORD, [longest]), (n == 1, INSIDE, [F.substring(first, 1, LONG + 1)]),
        (F.length(second) >= HALF, START, [F.substring(second, 1, HALF)]), (F.length(first) >= HALF, END, [tail(first, HALF)]), (F.lit(True), BORDER, [tail(first, 1), F.substring(second, 1, 1)]),
    ]
    found = None
    for test, kind, parts in choices:
        value = F.struct(F.lit(kind).alias("kind"), _key(kind, *parts).alias("key"))
        found = F.when(test, value) if found is None else found.when(test, value)
    return found


def _text_keys(words: Column, kinds: list[int]) -> Column:
    """The keys of those kinds that a text of these words has. `words` is used many times, so it must be a column."""
    at, last = (lambda k: F.get(words, k)), F.size(words) - 1
    steps = lambda n: F.slice(F.sequence(F.lit(0), F.greatest(F.lit(0), n)), 1, F.greatest(F.lit(0), n + 1))
    wide = F.filter(words, lambda w: F.length(w) >= HALF)
    offers = {
        WINDOW: F.transform(steps(last - FIVE + 1), lambda k: _key(WINDOW, *[at(k + i) for i in range(FIVE)])),
        WORD: F.transform(words, lambda w: _key(WORD, w)),
        START: F.transform(wide, lambda w: _key(START, F.substring(w, 1, HALF))),
        END: F.transform(wide, lambda w: _key(END, F.right(w, F.lit(HALF)))),
        INSIDE: F.flatten(F.transform(F.filter(words, lambda w: F.length(w) > LONG), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - LONG), lambda k: _key(INSIDE, F.substring(w, k, F.lit(LONG + 1)))))),
        BORDER: F.transform(steps(last - 1), lambda k: _key(BORDER, F.right(at(k), F.lit(1)), F.substring(at(k + 1), 1, 1))),
    }
    return F.array_distinct(F.concat(*[offers[k] for k in kinds]))


def leaks(docs: DataFrame, items: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """(doc_id, item_id, lines): how many different long lines of an item a document holds, white space apart. docs: (doc_id, text); items: (item_id, text).

    Null texts hold nothing. Lines of any number of words and any number of lines are looked for; all rows of one doc_id are one document for the count.
    """
    lines = items.select("item_id", F.explode(F.split("text", "\n")).alias("l")).where(F.length(F.regexp_replace("l", f"^{SPACE}+|{SPACE}+$", "")) > LONG)
    lines = lines.select("item_id", normalise(F.col("l")).alias("line")).distinct()
    lines = pinned(lines.withColumn("_w", F.split("line", " ")).select("item_id", "line", _line_key(F.col("_w")).alias("k")).select("item_id", "line", "k.kind", "k.key"))
    # Six numbers at most: texts offer only keys of the kinds that lines have.
    kinds = sorted(r.kind for r in lines.select("kind").distinct().collect())
    if not kinds:
        return docs.select("doc_id").join(lines.select("item_id").limit(0), F.lit(True)).limit(0).withColumn("lines", F.lit(0).cast("long"))
    keys = lines.select("key").distinct()
    few = keys.limit(most_keys + 1).count() <= most_keys
    texts = docs.where("text is not null").select("doc_id", "text")
    offered = texts.select("doc_id", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("w")).select("doc_id", F.explode(_text_keys(F.col("w"), kinds)).alias("key"))
    hits = offered.join(F.broadcast(keys) if few else keys, "key", "left_semi")
    # A table, so that Spark knows how small it is before it decides how texts meet it.
    met = pinned(hits.join(lines, "key").select("doc_id", "item_id", "line").distinct())
    found = texts.join(met, "doc_id").where(F.contains(normalise(F.col("text")), F.col("line"))).select("doc_id", "item_id", "line").distinct()
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("lines"))

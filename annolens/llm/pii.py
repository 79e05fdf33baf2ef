"""PII by bootstrapped contextual extraction.

Base recognisers find well-formed identifiers. These seed a bootstrap over lexical patterns: the words around an
identifier-like token. Patterns and the instances they surround form a bipartite graph that Spark scores in turns: a pattern's
confidence in a kind is the share of its distinct instances that are of that kind, weighted by their own scores, and
an unknown instance scores by the confident patterns that surround it. Patterns that are confident on enough instances
label unseen ones, which count as evidence in the next round. The graph is aggregated before it is joined, so a
pattern that surrounds a third of all identifiers is one group of partial sums, and nothing of it reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import materialize, narrow, slices

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts from this confidence and this weight of distinct instances; an instance from this score.
CONFIDENCE = 0.9
SUPPORT = 5.0
SCORE = 0.8

# Possessive forms of the base patterns, which find the same leftmost matches in time linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Identifier-like tokens: what a pattern may point at. Four digits at least, or an at sign, in six characters or more.
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"


def emails(text: str) -> list[tuple[int, int]]:
    found, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def ips(text: str) -> list[tuple[int, int]]:
    return [
        (m.start(), m.end())
        for run in _DOTTED.finditer(text)
        if run.end() - run.start() >= 7
        for m in _IP.finditer(text, run.start(), run.end())
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())
    ]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def cards(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then by start; code points, end exclusive."""
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        found += [("phone", *s) for s in phones(text)]
    return found


def _identifier_like(token: str) -> bool:
    return len(token) >= 6 and ("@" in token[1:-1] or sum("0" <= c <= "9" for c in token) >= 4)


def _whole(text: str, most: int) -> str:
    """A text as it is, or its SHA-256 if it is longer than `most`: all of it tells it apart, whatever is stored."""
    return text if len(text) <= most else hashlib.sha256(text.encode()).hexdigest()


def _word(token: str) -> str:
    return _whole(token.strip(_EDGE).lower() or token[:1], 64)


class Places:
    """Where the tokens of a text stand."""

    def __init__(self, text: str):
        self.text, self.spans = text, [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def before(self, start: int) -> list[str]:
        """The two words before a place; the part of a token that ends there is one."""
        k = bisect_left(self.starts, start)
        return [self.text[a : min(b, start)] for a, b in self.spans[max(0, k - 2) : k]]

    def after(self, end: int) -> str | None:
        k = bisect_left(self.starts, end)
        if k and self.spans[k - 1][1] > end:
            return self.text[end : self.spans[k - 1][1]]
        return self.text[slice(*self.spans[k])] if k < len(self.spans) else None


def contexts(places: Places, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before it, and the words on either side of it."""
    left = [_word(w) for w in places.before(start)]
    after = places.after(end)
    right = _word(after) if after else "."
    if not left:
        return []
    return [f"{' '.join(left)} _"] * (len(left) == 2) + [f"{left[-1]} _ {right}"]


def occurrences(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, list[str]]]:
    """(kind or None, start, end, instance, patterns): the base spans, and other identifier-like tokens outside of them."""
    if not (_DIGIT.search(text) or "@" in text):
        return []
    places = Places(text)
    found = [(kind, a, b, _whole(text[a:b].lower(), 64), contexts(places, a, b)) for kind, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for first, last in places.spans:
        whole = text[first:last]
        token = whole.strip(_EDGE)
        if not _identifier_like(token):
            continue
        start = first + whole.index(token)
        end = start + len(token)
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if any(start < b for _, b in takewhile(lambda span, end=end: span[0] < end, islice(taken, at, None))):
            continue
        found.append((None, start, end, _whole(token.lower(), 64), contexts(places, start, end)))
    return found


_SPAN = "struct<kind:string,start:long,end:long>"
_SEEN = "struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>"


def _arrow_span() -> list[tuple[str, pa.DataType]]:
    return [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]


def recognise(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, seen): base spans and all occurrences of each row of (doc_id, text).

    mark is a hash of the text, which tells rows that share an id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, seen = [], []
            for text in batch.column(2).to_pylist():
                found = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                seen.append([{"kind": k, "start": a, "end": b, "instance": i, "patterns": p} for k, a, b, i, p in occurrences(text, found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, pa.list_(pa.struct(_arrow_span()))), pa.array(seen, pa.list_(pa.struct([*_arrow_span(), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])))],
                ["doc_id", "mark", "base", "seen"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, f"doc_id {kind}, mark long, base array<{_SPAN}>, seen array<{_SEEN}>")


def bootstrap(edges: DataFrame, *, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT, score: float = SCORE) -> DataFrame:
    """(instance, kind, score) of unseen identifiers, from edges (pattern, instance, kind), kind null where unknown.

    Ties between kinds go to the higher score, then to the first name. No seeds give an empty result.
    """
    edges = edges.distinct()
    known = edges.where("kind is not null").select("pattern", "instance", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind is null").select("pattern", "instance")
    sizes = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("size"))
    found = known.limit(0).select("instance", "kind", "score")
    for _ in range(rounds):
        learned = unknown.join(found, "instance").select("pattern", "instance", "kind", "score")
        weight = known.unionByName(learned).groupBy("pattern", "kind").agg(F.sum("score").alias("weight"))
        good = weight.join(sizes, "pattern").withColumn("confidence", F.col("weight") / F.col("size")).where((F.col("confidence") >= confidence) & (F.col("weight") >= support))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        scored = unknown.join(good, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        best = scored.where(F.col("score") >= score).groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("rank"), "kind")).alias("best"))
        found = materialize(best.select("instance", "best.kind", (-F.col("best.rank")).alias("score")), "pii-found")
    return found


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, mark, base, spans), one row for each input row: arrays of (kind, start, end), by kind as in KINDS and then by start.

    base holds what the recognisers find, spans adds what the bootstrap finds, outside of the base spans. Null and empty texts have neither.
    Ties of kind and start go to the smaller end.
    Rows are matched by id and text, so repeated rows and null ids keep their own spans.
    """
    return _pii(narrow(docs, id_col, text_col), rounds)


def discovered(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(added_id, added_mark, added): the spans that the bootstrap adds to rows of recognise()."""
    each = seen.where(F.size("seen") > 0).select("doc_id", "mark", F.explode("seen").alias("s")).select("doc_id", "mark", "s.*")
    edges = materialize(each.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct(), "pii-edges")
    found = bootstrap(edges, rounds=rounds).select("instance", F.col("kind").alias("guess"))
    added = each.where("kind is null").join(found, "instance").groupBy("doc_id", "mark").agg(F.collect_set(F.struct(F.col("guess").alias("kind"), "start", "end")).alias("added"))
    return added.withColumnRenamed("doc_id", "added_id").withColumnRenamed("mark", "added_mark")


def _same_row() -> Column:
    return F.col("mark").eqNullSafe(F.col("added_mark")) & F.col("doc_id").eqNullSafe(F.col("added_id"))


def _pii(rows: DataFrame, rounds: int) -> DataFrame:
    seen = materialize(recognise(rows), "pii-seen")
    joined = seen.join(discovered(seen, rounds), _same_row(), "left")
    every = F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")))
    return joined.select("doc_id", "mark", "base", _in_order(every).alias("spans"))


#: Rows with added spans up to which they are broadcast; beyond, texts are shuffled to meet them.
FEW_ROWS = 200_000


def redacted(docs: DataFrame, *, rounds: int = ROUNDS, few: int = FEW_ROWS) -> DataFrame:
    """docs, a table with doc_id and text, with every span that pii() finds replaced by its kind in brackets.

    Null texts stay null, n_chars (if there is such a column) follows the new text, all else stays as it is.
    """
    added = materialize(discovered(materialize(recognise(narrow(docs)), "pii-seen"), rounds), "pii-added")
    rows = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    if added.isEmpty():
        joined = rows.withColumn("added", F.lit(None).cast(f"array<{_SPAN}>"))
    else:
        joined = rows.join(F.broadcast(added) if added.count() <= few else added, _same_row(), "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, more in zip(batch.column("text").to_pylist(), batch.column("added").to_pylist(), strict=True):
                extra = [(s["kind"], s["start"], s["end"]) for s in more or ()]
                texts.append(redact(text, base_spans(text) + extra) if text else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column("text").type) if n == "text" else batch.column(n) for n in names], names)

    out = joined.select(*names, "added").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def _in_order(spans: Column) -> Column:
    """Spans by kind as listed, then by start."""
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(place, s["kind"]).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame) -> DataFrame:
    """The columns of the search's contract, from its spans."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for start, end, kind in sorted(((a, b, k) for k, a, b in spans), key=lambda s: (s[0], -s[1])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
        else:
            at = max(at, end)
    return "".join([*parts, text[at:]])

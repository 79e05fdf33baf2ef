"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice that may hold k edits is cut into k + 1 pieces; by the pigeonhole principle one of them stands
unchanged in every match. One automaton over all pieces walks a text once, each hit places a window around
the notice it belongs to, and the regex library's bounded-error matching verifies the window and counts the edits.
Texts are matched as their words (A-Z in lower case, everything but ASCII letters, digits and non-ASCII characters
separates), joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, narrow, slices

# Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices searched with edits, and their labels.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the mozilla public license": "mpl",
    "licensed under the eclipse public license": "epl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution license": "cc-by",
    "creative commons zero public domain dedication": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Shortest piece that is worth a seed, and so the bound on edits: a notice of n characters may hold n // SEED - 1, two at most.
SEED = 8
MOST_EDITS = 2

WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def edits_of(notice: str) -> int:
    return max(0, min(MOST_EDITS, len(notice) // SEED - 1))


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces that cover the notice."""
    cuts = [len(notice) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, notices: dict[str, str]):
        self.notices = [(notice, label, edits_of(notice)) for notice, label in notices.items()]
        self.patterns = [regex.compile(rf"(?e)(?<= )(?:{regex.escape(n)}){{e<={k}}}(?= )") for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (notice, _, edits) in enumerate(self.notices):
            for offset, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) in a text of joined words with a space at either end."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for at, offset in owners:
                notice, _, edits = self.notices[at]
                begin = end + 1 - size - offset
                window = [max(0, begin - edits - 1), begin + len(notice) + edits + 1]
                mine = windows.setdefault(at, [])
                if mine and window[0] <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], window[1])
                else:
                    mine.append(window)
        found = []
        for at, areas in windows.items():
            for a, b in areas:
                for m in self.patterns[at].finditer(text, a, min(b, len(text))):
                    found.append((self.notices[at][1], m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(found, key=lambda x: (x[1], x[0], x[2]))


@cache
def scanner(notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(notices))


def base_places(joined: bytes, phrases: dict[str, str]) -> list[tuple[str, int, int]]:
    """(label, word, words): every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        while at >= 0:
            found.append((label, joined.count(b" ", 0, at), phrase.count(" ") + 1))
            at = joined.find(needle, at + 1)
    return found


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, places, spans), one row for each input row.

    places: array of (label, word, words) for exact phrases, word counted from 0. spans: array of
    (label, word, words, edits) for notices within their bound of edits, in characters: of each notice the leftmost places that do
    not overlap, each fitted as well as it can be.
    Null and wordless texts have no words, places or spans. Ids are carried as they are, null and repeated ones too.
    """
    phrases, fixed = dict(phrases or BASE), tuple((notices or NOTICES).items())
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    place = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64())]))
    span = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("words", pa.int64()), ("edits", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = scanner(fixed)
        for batch in slices(batches):
            counts, places, spans = [], [], []
            for text in byte_texts(batch.column(1)):
                words = text.translate(WORDS).split()
                joined = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                places.append([{"label": x, "word": w, "words": n} for x, w, n in sorted(base_places(joined, phrases), key=lambda p: p[1])])
                plain = joined.decode()
                spans.append([{"label": x, "word": plain.count(" ", 0, a - 1), "words": plain.count(" ", a, b) + 1, "edits": e} for x, a, b, e in search.spans(plain)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)], ["doc_id", "n_words", "places", "spans"])

    shape = f"doc_id {kind}, n_words long, places array<struct<label:string,word:long,words:long>>, spans array<struct<label:string,word:long,words:long,edits:long>>"
    return narrow(docs, id_col, text_col).mapInArrow(run, shape)


def license_digest(found: DataFrame) -> DataFrame:
    """The columns of the scan's contract, from its places and spans."""

    def labels(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    near = F.array_max(F.transform("spans", lambda s: 1 - s["edits"].cast("double") / (MOST_EDITS + 2)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        labels(F.col("places.label")).alias("base_labels"),
        labels(F.concat("places.label", "spans.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(near, F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["word"].cast("string"), s["words"].cast("string"), s["edits"].cast("string"))), ",").alias("spans"),
    )

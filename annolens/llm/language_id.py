"""Language identification by compression.

Each language has a zstandard raw-content dictionary, cut from a bounded sample of its documents. A text is compressed
with each, block by block so that the dictionary counts as much at the end of a long text as at its start, and
the language whose dictionary gives the fewest bytes wins. A narrow margin between the best two marks the row as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, narrow, slices

#: Documents of each language in the sample, in expectation, and bytes of its dictionary at most.
SAMPLE_DOCS = 300
DICTIONARY_BYTES = 96 * 1024
#: Bytes of a text that are compressed at once, and zstandard's level: from 6 it searches the dictionary well.
BLOCK = 1024
LEVEL = 6
#: Relative margin below which a prediction counts as rejected.
MARGIN = 0.01
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """A dictionary for each language, in the order of the languages' names."""

    dictionaries: dict[str, bytes]


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> LanguageModel:
    """Dictionaries from the rows that `learn` selects; null texts and null languages teach nothing.

    A language's sample is the rows whose id hashes below sample / rows of that language, so about `sample` rows reach the driver
    for each language however many there are; the languages themselves are taken to be few. Whole documents are
    laid in hash order until `size` bytes are full.
    """
    rows = docs.where(learn).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel({})
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bound = F.lit(0).cast("long")
    for lang, n in sorted(counts.items()):
        bound = F.when(F.col("lang") == lang, F.lit(int((1 << 40) * min(1.0, sample / n)))).otherwise(bound)
    picked = rows.withColumn("order", order).where(F.col("order") < bound).select("lang", "order", "doc_id", "text").collect()
    texts: dict[str, list[tuple[int, str, bytes]]] = {}
    for r in picked:
        texts.setdefault(r["lang"], []).append((r["order"], str(r["doc_id"]), r["text"].encode()))
    made = {}
    for lang, found in sorted(texts.items()):
        content = bytearray()
        for _, _, text in sorted(found):
            content += plain(text) + b" "
            if len(content) >= size:
                break
        made[lang] = bytes(content[:size])
    return LanguageModel(made)


# Words in lower case: case and marks are no sign of a language here and only cost matches.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: bytes) -> bytes:
    return b" ".join(text.translate(_PLAIN).split())


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


class Classifier:
    def __init__(self, model: LanguageModel, level: int = LEVEL):
        self.names = list(model.dictionaries)
        self.coders = []
        for content in model.dictionaries.values():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        text = plain(text)
        blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)] or [b""]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: bytes) -> tuple[str, float]:
        """(language, relative margin to the next best); ties go to the first name."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [x for k, x in enumerate(sizes) if k != best]
        return self.names[best], 1 - sizes[best] / min(rest) if rest else 1.0


def language_id(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row for each input row.

    lang_pred is a learned language, or "und" with score 0 if the text is null or has no letter, or if nothing was
    learned. score is the relative margin of the best over the next best size, 0 to 1 (1 if only one language was learned); rejected
    says that it is below `margin`. Only texts are looked at. Ids are carried as they are.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(model)
        for batch in slices(batches):
            found = [classifier.predict(x) for x in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < margin for _, s in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")

"""Phrase mining level by level: words, then phrases of two, three and four words.

A phrase of k words is as frequent as its two overlapping parts of k - 1 words at most, so pass k counts only places where both parts are frequent. What a pass
needs to know of the level before is broadcast as a bitmap of hashed phrases: SLOTS bits (32 MB) at most, whatever the corpus. Two phrases that share a bit
only let a phrase through to be counted; counts are of the phrases themselves, and the levels' tables keep the frequent ones alone. Counting takes
a block of texts at once: places become numbers of distinct phrases, and each block sends one row a phrase, which Spark adds up on the map side, then by phrase.
Scores, cuts and containment come from joins of the levels' tables, which are tables of their own, so that Spark can split a part that many phrases share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, materialize
from annolens.llm.crc import Words

# What every byte of a text becomes (A-Z in lower case, tab a space, every mark that ends a piece a full stop), and the language of rows without one.
ENDS = b".,;:!?\n\x0b\x0c\r"
BYTES = bytes(46 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
NO_LANG = "und"

LONGEST = 4
LEAST = 30
COVERED = 80
TOP = 2000
SCALE = 2_000_000
PARTS = 64
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28
#: Words of texts that are counted at once.
BLOCK = 1 << 19


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[str], list[bytes], np.ndarray]]:
    """(languages, words of all texts with b"." between pieces, the words' languages as places in the list) of some `size` words each."""
    langs: dict[str, int] = {}
    words: list[bytes] = []
    of: list[np.ndarray] = []
    for batch in batches:
        names = batch.column(0).to_pylist()
        for at in range(0, batch.num_rows, 256):
            for name, text in zip(names[at : at + 256], byte_texts(batch.column(1).slice(at, 256)), strict=True):
                found = text.translate(BYTES).replace(b".", b" . ").split()
                words += found
                words.append(b".")
                of.append(np.full(len(found) + 1, langs.setdefault(name, len(langs)), np.int64))
                if len(words) >= size:
                    yield list(langs), words, np.concatenate(of)
                    langs, words, of = {}, [], []
    if words:
        yield list(langs), words, np.concatenate(of)


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the distinct keys, one for each key: by hash, which is faster than sorting where few are distinct."""
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def _counted(block: tuple[list[str], list[bytes], np.ndarray], memory: Words, k: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """(lang, phrase, n) of a block's phrases of k words whose parts of k - 1 words both have their bit set."""
    langs, words, lang = block
    # Only a block's distinct words become Python objects again, and only where they are hashed.
    text = pa.array(words, pa.large_binary()).dictionary_encode()
    known, own = text.dictionary, text.indices.to_numpy().astype(np.int64)
    word = own != known.index(pa.scalar(b".", pa.large_binary())).as_py()
    starts = word.copy()
    if k > 1:
        # The hash of a phrase goes on from that of its language.
        numbers = memory.numbers(known.to_numpy(zero_copy_only=False).tolist())[own]
        heads = np.array([zlib.crc32(x.encode()) for x in langs], np.uint32)
        run = memory.joined(heads[lang], numbers)
        for j in range(1, k - 1):
            run = memory.joined(run[: len(run) - 1], numbers[j:])
        slot = run & np.uint32(len(bits) * 8 - 1)
        frequent = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        starts = np.zeros(len(words), bool)
        n = max(0, len(words) - k + 1)
        starts[:n] = frequent[:n] & frequent[1 : n + 1]
        for j in range(k):
            starts[:n] &= word[j : j + n]
    places = np.flatnonzero(starts)
    # A phrase's number so far and its next word make the number of the longer phrase: exact, and below 2^32 each.
    group = lang[places]
    for j in range(k):
        keys = (group << 32) | own[places + j]
        group = np.unique(keys, return_inverse=True)[1] if j else _numbered(keys)
    n = np.bincount(group)
    # Any place of a phrase will do.
    at = np.zeros(len(n), np.int64)
    at[group] = places
    parts = [known.take(pa.array(own[at + j])) for j in range(k)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[at])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def count_level(texts: DataFrame, k: int, bits: bytes | None = None, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, n): all words (k = 1), or phrases of k words whose two parts may be frequent by the bitmap. texts: (lang, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Words()
        known = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for part in _blocks(batches, block):
            yield _counted(part, memory, k, known)

    return texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def slots_for(rows: int) -> int:
    return max(LEAST_SLOTS, min(MOST_SLOTS, 1 << (16 * rows).bit_length()))


def bitmap(level: DataFrame, slots: int | None = None) -> bytes:
    """The bits of a level's phrases: slots / 8 bytes, MOST_SLOTS / 8 at most, put together from rows of 4 KB."""
    slots = slots or slots_for(level.count())
    slot = F.crc32(F.concat_ws(" ", "lang", "phrase").cast("binary")).bitwiseAND(F.lit(slots - 1)) + 1
    rows = level.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    whole = bytearray(max(slots // 8, 4096))
    for r in rows.toLocalIterator():
        whole[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
    return bytes(whole[: slots // 8])


def _words_of(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def scored_cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase under its lowest-scoring cut, ties to the smallest first part. Both: (lang, phrase, k, n)."""
    words = _words_of()
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = phrases.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("words") - F.col("cut")).alias("right"))
    left = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    met = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr(f"cast(a as decimal(19, 0)) * cast({SCALE} as decimal(7, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def covered(phrases: DataFrame, share: int = COVERED) -> DataFrame:
    """(lang, phrase) of those inside a longer phrase that is at least `share` percent as frequent. phrases: (lang, phrase, k, n)."""
    words = _words_of()
    inner = phrases.where("k > 2").select("lang", F.col("n").alias("longer"), words.alias("words"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "longer", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("start"))
    inner = inner.select("lang", "longer", F.array_join(F.slice("words", F.col("start"), F.col("size")), " ").alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, ["lang", "phrase"]).where(F.expr(f"cast(100 as decimal(20, 0)) * longer >= cast({share} as decimal(20, 0)) * n")).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = LONGEST, least: int = LEAST, share: int = COVERED, top: int = TOP, slots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, then count, both descending, then phrase.

    Null texts are empty; rows without a language are of the language `und`. Repeated rows count as often as they stand. Empty tables, and languages without a
    phrase that is frequent enough, give no rows. Other columns are ignored.
    """
    if not 2 <= longest <= 4 or least < 1:
        raise ValueError("phrases have two to four words and occur once at least")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = materialize(count_level(texts, 1, block=block), "phrases-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("words"))
    level = words.where(F.col("n") >= least)
    counts = level.withColumn("k", F.lit(1))
    for k in range(2, longest + 1):
        level = materialize(count_level(texts, k, bitmap(level, slots), block).where(F.col("n") >= least), f"phrases-{k}")
        counts = counts.unionByName(level.withColumn("k", F.lit(k)))
    phrases = counts.where("k > 1")
    cuts = materialize(scored_cuts(phrases, counts), "phrases-cuts")
    left = cuts.join(covered(phrases, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of a fixed number of parts of a language, then the best of those: the last task sees PARTS * top rows of a language, however many tasks there are.
    parted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")

"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is cut into words by the tokenizer's pattern. A word's bytes, as an array of piece ids, are folded: a literal map gives
the rank of each pair of neighbours (which is the id of what they make), and each step joins the first pair of the lowest rank
and looks up the two pairs that this makes new, until none has a rank. Distinct words that a sample of documents repeats are folded once,
as a table, which is broadcast with a bounded number of rows. A batch of texts looks its words up in it with Arrow; each document keeps
its distinct other words, those are folded, and their ids go where the words stood. Decoding looks each id's bytes up in a literal array and concatenates them.

Catalyst scans a map literal from its start, so the literal map of pairs is an array of small maps, by the hash of the key.
A fold takes steps in proportion to a word's length, each of which copies its pieces, so a word of LONGEST characters or more
goes through the tiktoken library instead, that word alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from annolens.llm.base import SLICE, materialize, narrow

# Fixed value: the tokenizer's word pattern in Java's syntax; white space is Unicode's White_Space.
_SPACE = r"\t-\r\x{85}\p{Z}"
JAVA_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
LONGEST = 512
#: Words of the broadcast table, and the documents they are looked for in, in expectation. They only save work.
FREQUENT = 600_000
SAMPLE_DOCS = 128_000
#: Small maps of the literal map of pairs.
PAIR_BUCKETS = 65_537
#: A state of a fold is an array of numbers: the rank of the pair that a piece opens, where the piece began, and the piece.
PIECE, PLACE = 1 << 20, 1 << 40
UNRANKED = 1 << 20


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@cache
def library(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a transform of one element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, none of them null, and where each list begins, and the end."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(at[0], at[-1] - at[0]), at - at[0]


def _lists(at: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): each batch's distinct words. Batches: (words)."""
    for batch in batches:
        found = pc.value_counts(_flat(batch.column(0))[0])
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["key", "n"])
        pa.default_memory_pool().release_unused()


def looked_up(words: pa.ListArray, keys: pa.Array, ids: pa.ListArray) -> Iterator[pa.StructArray]:
    """(ids, unknown) of each document's words, some documents at a time: the ids of those among the keys, with -1 - k where its distinct unknown word k stands, and these words.

    ids: those of the keys, and [-1] behind them.
    """
    flat, ends = _flat(words)
    found = pc.index_in(flat, value_set=keys)
    for first in range(0, len(words), SLICE):
        at = ends[first : first + SLICE + 1]
        here, of, at = flat.slice(at[0], at[-1] - at[0]), pc.fill_null(found.slice(at[0], at[-1] - at[0]), len(keys)), at - at[0]
        taken = ids.take(of)
        numbers = taken.values.to_numpy().copy()
        places = np.flatnonzero(of.to_numpy() == len(keys))
        doc = np.searchsorted(at, places, "right") - 1
        unknown = here.take(pa.array(places)).dictionary_encode()
        pairs = pa.array((doc << 32) | unknown.indices.to_numpy().astype(np.int64)).dictionary_encode()
        distinct = pairs.dictionary.to_numpy()
        begins = np.concatenate([[0], np.cumsum(np.bincount(distinct >> 32, minlength=len(at) - 1))])
        numbers[numbers < 0] = -1 - (pairs.indices.to_numpy() - begins[doc])
        lists = [_lists(taken.offsets.to_numpy()[at], pa.array(numbers)), _lists(begins, unknown.dictionary.take(pa.array(distinct & 0xFFFFFFFF)))]
        yield pa.StructArray.from_arrays(lists, ["ids", "unknown"])


def put_back(ids: pa.ListArray, folded: pa.ListArray) -> Iterator[pa.ListArray]:
    """ids with each -1 - k replaced by what the document's unknown word k was folded to, some documents at a time."""
    numbers, ends = _flat(ids)
    words, begins = _flat(folded)
    for first in range(0, len(ids), SLICE):
        at = ends[first : first + SLICE + 1]
        here, at = numbers.slice(at[0], at[-1] - at[0]).to_numpy(), at - at[0]
        places = np.flatnonzero(here < 0)
        doc = first + np.searchsorted(at, places, "right") - 1
        taken = words.take(pa.array(begins[doc] - 1 - here[places]))
        sizes = np.ones(len(here), np.int64)
        sizes[places] = np.diff(taken.offsets.to_numpy())
        out = np.repeat(here, sizes)
        out[out < 0] = taken.values.to_numpy()
        yield _lists(np.concatenate([[0], np.cumsum(sizes)])[at], pa.array(out))


def as_bytes(ids: pa.ListArray) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers, at = _flat(ids)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(numbers.to_numpy().astype("<u4"))])


def _piece(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PIECE - 1).cast("long"))


class Codec:
    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.spark, self.path, self.pattern = spark, path, pattern
        ranks = ranks_of(path)
        size = max(ranks.values()) + 1
        # A piece is known by its rank, so a pair of pieces is one number.
        self.base = size
        pairs: list[dict[str, int]] = [{} for _ in range(PAIR_BUCKETS)]
        for made, rank in ranks.items():
            for cut in range(1, len(made)):
                left, right = ranks.get(made[:cut]), ranks.get(made[cut:])
                if left is not None and right is not None:
                    key = left * size + right
                    pairs[key % PAIR_BUCKETS][str(key)] = rank
        self.pairs = F.from_json(F.lit(json.dumps(pairs)), "array<map<string,int>>").cast("array<map<bigint,int>>")
        self.single = F.from_json(F.lit(json.dumps([ranks[bytes([k])] for k in range(256)])), "array<int>")
        by_id = [""] * size
        for k, v in ranks.items():
            by_id[v] = k.hex()
        self.pieces = F.from_json(F.lit(json.dumps(by_id)), "array<string>")
        self.frequent = pa.table({"key": pa.array([], pa.string()), "value": pa.array([], pa.list_(pa.int32()))})

    def words(self, text: str) -> Column:
        return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))

    def rank(self, pairs: Column, left: Column, right: Column) -> Column:
        """The rank of two neighbours, UNRANKED if they do not merge or one is null."""
        key = left * F.lit(self.base).cast("long") + right
        return F.coalesce(F.try_element_at(F.get(pairs, F.pmod(key, F.lit(PAIR_BUCKETS)).cast("int")), key), F.lit(UNRANKED)).cast("long")

    def fold(self, word: Column, pairs: Column | None = None) -> Column:
        """The ids of a word: ranked merges folded over its bytes. pairs is self.pairs or a variable bound to it."""
        if pairs is None:
            return _bound(self.pairs, lambda bound: self.fold(word, bound))
        # one character a byte, whose code is the byte
        chars = F.decode(word.cast("binary"), "ISO-8859-1")
        start = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda at: F.get(self.single, F.ascii(F.substring(chars, at, F.lit(1)))))
        state = _bound(start, lambda p: F.transform(p, lambda piece, at: self.rank(pairs, piece, F.get(p, at + 1)) * PLACE + at.cast("long") * PIECE + piece))
        merged = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.octet_length(word))), state, lambda s, _: self._step(pairs, s))
        return F.transform(merged, lambda x: _piece(x).cast("int"))

    def _step(self, pairs: Column, state: Column) -> Column:
        """Join the first pair of the lowest rank: its left piece becomes the whole, its right piece goes."""

        def joined(best: Column, at: Column) -> Column:
            made = F.shiftright(best, 40)
            behind = _piece(F.get(state, at + 1))
            here = self.rank(pairs, made, behind) * PLACE + best.bitwiseAND(F.lit(PLACE - PIECE)) + made
            return F.transform(
                F.filter(state, lambda _, i: i != at),
                lambda x, i: F.when(i == at - 1, here).when(i == at - 2, self.rank(pairs, _piece(x), made) * PLACE + x.bitwiseAND(F.lit(PLACE - 1))).otherwise(x),
            )

        def merged(best: Column) -> Column:
            return F.when(best >= F.lit(UNRANKED * PLACE), state).otherwise(_bound(F.array_position(state, best).cast("int"), lambda at: joined(best, at)))

        return _bound(F.array_min(state), merged)

    def learn(self, rows: DataFrame, total: int, *, frequent: int = FREQUENT, sample: int = SAMPLE_DOCS) -> None:
        """Fold the most frequent words of a bounded sample of documents once, as a table of distinct words: `frequent` at most, all with a count above some number."""
        span = 1 << 40
        share = int(span * min(1.0, sample / max(1, total)))
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(span)) < share)
        counted = part.select(self.words("text").alias("words")).mapInArrow(counted_words, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
        counted = materialize(counted.where((F.char_length("key") < LONGEST) & (F.col("n") > 1)), "bpe-words", clear=True)
        least, kept = 2, 0
        # Counts of few documents take few values.
        for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
            kept += r.words
            if kept > frequent:
                least = r.n + 1
                break
        top = counted.where(F.col("n") >= least).repartition(self.spark.sparkContext.defaultParallelism)
        self.frequent = top.select("key", self.fold(F.col("key")).alias("value")).toArrow()

    def ids(self, rows: DataFrame) -> DataFrame:
        """(doc_id, ids, id_bytes) of rows (doc_id, text). Words that learn() has not found are folded, each distinct one of a document once."""
        keys = self.frequent.column("key").cast(pa.string()).combine_chunks()
        value = pa.chunked_array([*self.frequent.column("value").cast(pa.list_(pa.int32())).chunks, pa.array([[-1]], pa.list_(pa.int32()))]).combine_chunks()
        shared = self.spark.sparkContext.broadcast((keys, value))
        path, pattern = self.path, self.pattern

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in looked_up(batch.column(1), *shared.value):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), part.field("ids"), part.field("unknown")], ["doc_id", "ids", "unknown"])
                    at += len(part)
                pa.default_memory_pool().release_unused()

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                inner, begins = _flat(batch.column(3))
                if inner.null_count:
                    core = library(path, pattern)._core_bpe
                    pairs = zip(_flat(batch.column(2))[0].to_pylist(), inner.to_pylist(), strict=True)
                    inner = pa.array([core.encode_single_piece(word.encode()) if x is None else x for word, x in pairs], pa.list_(pa.int32()))
                at = 0
                for ids in put_back(batch.column(1), _lists(begins, inner)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), ids, as_bytes(ids)], ["doc_id", "ids", "id_bytes"])
                    at += len(ids)
                pa.default_memory_pool().release_unused()

        schema = StructType([rows.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("unknown", ArrayType(StringType()))])
        found = rows.select("doc_id", self.words("text").alias("words")).mapInArrow(look_up, schema)
        short = lambda pairs: F.transform("unknown", lambda w: F.when(F.char_length(w) < LONGEST, self.fold(w, pairs)))
        return found.withColumn("folded", _bound(self.pairs, short)).mapInArrow(whole, StructType([*schema[:2], StructField("id_bytes", BinaryType())]))

    def decode(self, ids: str) -> Column:
        """The bytes that ids stand for."""
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, frequent: int = FREQUENT) -> tuple[DataFrame, Codec]:
    """(doc_id, ids array<int>, id_bytes: the same as little-endian unsigned 32-bit integers), one row for each input row, and the codec that decodes them.

    Null and empty texts have no ids. Ids of documents are carried as they are, null and repeated ones too.
    """
    rows = narrow(docs, id_col, text_col)
    codec = Codec(docs.sparkSession, path, pattern)
    if frequent:
        codec.learn(rows, rows.count(), frequent=frequent)

    return codec.ids(rows), codec


def bpe_digest(encoded: DataFrame, codec: Codec) -> DataFrame:
    """The columns of the contract: counts and hashes of the ids and of what they decode to."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("id_bytes", 256).alias("ids_sha256"),
        F.sha2(codec.decode("ids"), 256).alias("decoded_sha256"),
    )


def digest_of(text: str, path: str, pattern: str) -> tuple[int, str, str]:
    """The same for one text through the library, to compare with."""
    ids = library(path, pattern).encode_ordinary(text)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

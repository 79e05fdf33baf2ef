"""Lexical retrieval packing: windows of related documents, filled through a sharded BM25 inverted index.

Rarity of terms and mean length are those of all documents: the tasks that turn texts into ids also count the documents of
each term, a table as long as the vocabulary. A document then goes where its rarest term goes that enough documents share,
so that likely neighbours meet wherever they were read; a term that very many documents go by is salted. Each task cuts its
documents, ordered by that term, into shards of bounded size and indexes one at a time: postings of token ids with BM25 weights.
A window opens with a seed document; the index returns the unused documents of the shard that match it best, and these fill
the window in that order. What does not fit is cut off and seeds the next window, so windows are full. At the end of a
task's documents the last window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import materialize, narrow, slices
from annolens.llm.word_tokens import word_tokenizer

WINDOW = 4096
END_ID = 2
#: A shard closes with this many documents or tokens.
SHARD_DOCS = 2048
SHARD_TOKENS = 4_000_000
#: Documents that hold a term from which it may gather them, and documents of one salt of a term that gathers more.
SHARED = 16
SALT_DOCS = 256
#: Tokens of a task that packs: at least, where the session's shuffle partitions are more than enough, and at most, beyond them.
LEAST_TOKENS, MOST_TOKENS = 1 << 18, 1 << 27
K1 = 1.2
B = 0.75
#: Neighbours that one look at the scores returns; a window that needs more looks again.
LOOK = 16


class Corpus:
    """What BM25 asks of all documents: in how many each term occurs, and their mean length."""

    def __init__(self, holders: np.ndarray, docs: int, tokens: int):
        self.holders, self.docs, self.tokens, self.mean = holders, docs, tokens, max(1.0, tokens / max(1, docs))
        # The probabilistic weight of a term that half of the documents hold is nothing.
        self.rarity = np.maximum(0.0, np.log((docs - holders + 0.5) / (holders + 0.5))).astype(np.float32)

    @classmethod
    def of(cls, docs: list[np.ndarray], size: int) -> Corpus:
        holders = np.zeros(size, np.int64)
        for ids in docs:
            holders[np.unique(ids)] += 1
        return cls(holders, len(docs), sum(map(len, docs)))


class Index:
    """BM25 postings of a shard: for each term its documents and their weights, by the corpus' statistics."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        self.terms = []
        owners, weights, terms = [], [], []
        mean = corpus.mean
        for at, ids in enumerate(docs):
            found, counts = np.unique(ids, return_counts=True)
            self.terms.append(found)
            terms.append(found)
            owners.append(np.full(len(found), at, np.int32))
            weights.append((counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32))
        every = np.concatenate(terms)
        order = np.argsort(every, kind="stable")
        every = every[order]
        self.size = len(docs)
        self.vocabulary, self.starts = np.unique(every, return_index=True)
        self.starts = np.append(self.starts, len(every))
        holders = np.diff(self.starts)
        rarity = corpus.rarity[self.vocabulary]
        self.rarity = rarity
        self.owners = np.concatenate(owners)[order]
        self.weights = np.concatenate(weights)[order] * np.repeat(rarity, holders)

    def scores(self, at: int) -> np.ndarray:
        places = np.searchsorted(self.vocabulary, self.terms[at])
        places = places[self.rarity[places] > 0]
        if not len(places):
            return np.zeros(self.size, np.float32)
        spans = [slice(a, b) for a, b in zip(self.starts[places], self.starts[places + 1], strict=True)]
        return np.bincount(np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size)


class Packer:
    """Pieces (doc, start, length, crc, doc_tokens, sequence, offset), window by window."""

    def __init__(self, first_sequence: int, corpus: Corpus, window: int = WINDOW):
        self.corpus, self.window, self.sequence, self.filled = corpus, window, first_sequence, 0
        self.open: list[tuple] = []
        self.done: list[tuple] = []

    def _close(self) -> None:
        self.done += self.open
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def put(self, doc: object, ids: np.ndarray) -> bool:
        """Lay a whole document down, over as many windows as it takes; says whether a window was closed on the way."""
        start, closed = 0, False
        while start < len(ids):
            length = min(self.window - self.filled, len(ids) - start)
            piece = ids[start : start + length]
            self.open.append((doc, start, length, piece, len(ids), self.sequence, self.filled))
            start, self.filled = start + length, self.filled + length
            if self.filled == self.window:
                self._close()
                closed = True
        return closed

    def shard(self, docs: list[tuple[object, np.ndarray]]) -> None:
        index, used = Index([ids for _, ids in docs], self.corpus), np.zeros(len(docs), bool)
        seed = 0
        while seed < len(docs):
            if used[seed]:
                seed += 1
                continue
            used[seed] = True
            self.put(*docs[seed])
            current = seed
            while self.filled:
                scores = index.scores(current)
                scores[used] = -1
                closed = False
                while not closed:
                    best = np.argsort(-scores, kind="stable")[:LOOK] if LOOK >= index.size else self._best(scores)
                    best = [int(k) for k in best if scores[k] > 0]
                    if not best:
                        break
                    for k in best:
                        used[k], scores[k] = True, -1
                        if closed := self.put(*docs[k]):
                            current = k
                            break
                if not closed:
                    break  # nothing in the shard matches any more: the next document in order goes on in this window

    @staticmethod
    def _best(scores: np.ndarray) -> np.ndarray:
        top = np.argpartition(-scores, LOOK)[:LOOK]
        return top[np.lexsort((top, -scores[top]))]

    def finish(self) -> None:
        """Cut the last window into sequences of powers of two, largest first."""
        rest, self.open = self.open, []
        total, self.filled = self.filled, 0
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            while room:
                doc, start, length, ids, tokens, _, _ = rest[0]
                take = min(room, length)
                self.open.append((doc, start, take, ids[:take], tokens, self.sequence, self.filled))
                self.filled += take
                room -= take
                if take == length:
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + take, length - take, ids[take:], tokens, 0, 0)
            self._close()

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def _encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> tuple[DataFrame, Corpus, str]:
    """A written table (doc_id, at, ids), one row a document under a number of its own, the corpus' statistics and the ids' Numpy type.

    Each task that has documents adds a row of its own to the table: documents by term, and tokens at the end.
    """
    kind, first = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"], word_tokenizer(tokenizer)
    exact, size = first.exact, max(first.size, end_id + 1)
    small = "<u2" if size <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, at = word_tokenizer(tokenizer, exact), np.zeros(size + 1, np.int64), TaskContext.get().partitionId() << 33
        names = ["doc_id", "at", "ids", "counts"]
        for batch in slices(batches):
            found = [np.frombuffer(encoder.encode(text) + end, "<u4") for text in batch.column(1).to_pylist()]
            for ids in found:
                counts[np.unique(ids)] += 1
                counts[-1] += len(ids)
            n = len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(at, at + n)), pa.array([x.astype(small).tobytes() for x in found], pa.binary()), pa.nulls(n, pa.binary())], names)
            at, kept = at + n, batch.column(0).type
        if counts[-1]:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kept), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total += np.frombuffer(row, "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    table = materialize(narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, at long, ids binary, counts binary"), "packing-ids")
    # One row a term: bounded by the vocabulary.
    terms = table.where("counts is not null").select("counts").mapInArrow(summed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size + 1, np.int64)
    total[terms.column("term").to_numpy()] = terms.column("n").to_numpy()
    # Every document holds its end.
    return table.where("ids is not null").select("doc_id", "at", "ids"), Corpus(total[:-1], int(total[end_id]), int(total[-1])), small


def gathered(encoded: DataFrame, corpus: Corpus, small: str, *, shared: int = SHARED, salt_docs: int = SALT_DOCS) -> DataFrame:
    """The encoded documents, dealt and ordered by their rarest term that at least `shared` documents hold.

    A document without such a term goes by its end, which all hold. What as many documents may go by as hold the term is
    salted by the documents' numbers, salt_docs at a time, however alike they are.
    """
    order = np.where(corpus.holders >= min(shared, max(1, corpus.docs)), corpus.holders, np.iinfo(np.int64).max)
    sent = encoded.sparkSession.sparkContext.broadcast((order, np.maximum(1, -(-corpus.holders // salt_docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, salts = sent.value
        for batch in slices(batches):
            found = [np.frombuffer(x, small) for x in batch.column(2).to_pylist()]
            terms = np.array([x[np.argmin(order[x])] for x in found], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(terms), pa.array(salts[terms])], [*batch.schema.names, "term", "salts"])

    fields = ", ".join(f"{name} {kind}" for name, kind in encoded.dtypes)
    keyed = encoded.mapInArrow(run, f"{fields}, term long, salts long").withColumn("salt", F.pmod(F.xxhash64("at"), F.col("salts")))
    # A number of its own: packing costs far more than its bytes tell, so these tasks must not be coalesced.
    tokens, usual = corpus.tokens, int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(usual, -(-tokens // LEAST_TOKENS)), -(-tokens // MOST_TOKENS), 1)
    return keyed.repartition(tasks, "term", "salt").sortWithinPartitions("term", "salt", "at").select("doc_id", "ids")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece of a document.

    A document is its ids and end_id; null and empty texts are that id alone. Each id lies in exactly one piece, and a
    sequence's pieces lie behind one another from 0. Sequences hold `window` ids; the last ones of each shuffled partition
    hold a smaller power of two. sequence_id is that partition's number times 2^33, plus a count. Equal
    scores go to the document that comes first in its shard. Repeated rows and null ids are packed like others; an empty table
    gives no pieces.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    encoded, corpus, small = _encoded(docs, tokenizer, id_col, text_col, end_id)
    sent = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, sent.value, window)
        waiting: list[tuple[object, np.ndarray]] = []
        tokens, kept = 0, None
        for batch in slices(batches):
            kept = batch.schema.field(0).type
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, small).astype("<u4")
                waiting.append((doc, ids))
                tokens += len(ids)
                if len(waiting) >= shard_docs or tokens >= shard_tokens:
                    packer.shard(waiting)
                    waiting, tokens = [], 0
                    yield _batch(packer.take(), kept)
        if waiting:
            packer.shard(waiting)
        packer.finish()
        if rows := packer.take():
            yield _batch(rows, kept)

    return gathered(encoded, corpus, small).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    crcs = [zlib.crc32(x.tobytes()) for x in columns[3]]
    rest = [pa.array(columns[k], pa.int64()) for k in (1, 2)], [pa.array(columns[k], pa.int64()) for k in (4, 5, 6)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *rest[0], pa.array(crcs, pa.int64()), *rest[1]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

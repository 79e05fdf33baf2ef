"""Importance resampling towards a target's word statistics, drawn exactly without a full sort.

Features are runs of words hashed into a fixed number of buckets. One pass counts the buckets on the map side, the gains of all buckets are one
array that every task gets, and a second pass gives each document the mean gain of its features. Gumbel noise from the document's id makes the
draw of the highest scores a draw without replacement by weight.

The draw sorts no row that is not drawn, but for the last score's ties. A count of rows a score (scores are whole numbers of a known span) tells the
score of the last draw and cuts the scores above into ranges of bounded size. Each partition of eligible rows is sorted into a run, cut into
blocks at the ranges' ends, and the blocks of a range meet in one task, where a tournament tree merges the runs: a block enters
the tree when its first key is due and leaves when it is empty, so a task holds the blocks that overlap, never its range. Ranks are the range's offset
plus the place in the merge, which stops ranking at the exact count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, materialize, narrow, slices
from annolens.llm.crc import Words

# Fixed value: what every byte of a text becomes: A-Z in lower case, ASCII that is no letter or digit a separator.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
#: Rows of a range that meet in one task, and of a block of a run.
LEAST_RANGE, MOST_RANGE, BLOCK = 1024, 1 << 18, 2048


def _features(words: Words, batch: pa.RecordBatch, column: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2... words: (CRCs of all runs in the batch, each text's first run, the run after its last)."""
    tokens, ends = [], []
    for text in byte_texts(batch.column(column)):
        tokens += text.translate(WORDS).split()
        ends.append(len(tokens))
    numbers, end = words.numbers(tokens), np.array(ends, np.int64)
    start = np.concatenate([np.zeros(1, np.int64), end[:-1]])
    crc = words.first(numbers)
    for k in range(1, longest + 1):
        first = np.minimum(start, len(crc))
        yield crc, first, np.maximum(first, end - k + 1)
        crc = words.joined(crc[:-1], numbers[k:])


def bucket_counts(docs: DataFrame, text_col: str = "text", *, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features all texts have in each bucket. Tasks send one row a bucket; the driver gets `buckets` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for crc, start, end in _features(words, batch, 0, longest):
                # Runs that go from one text into the next belong to none.
                inside = np.zeros(len(crc) + 1, np.int64)
                np.add.at(inside, start, 1)
                np.add.at(inside, end, -1)
                total += np.bincount(crc[np.cumsum(inside)[:-1] > 0] % buckets, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in found:
        counts[r.bucket] = r.n
    return counts


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * log ratio) of each bucket's add-one smoothed shares, in doubles."""
    size, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(scale * math.log((float(target[k] + 1) * all_source) / (float(source[k] + 1) * all_target))) for k in range(size)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", *, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each text's features, 0 where there are none."""
    kind, buckets = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"], len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            sums = np.zeros(batch.num_rows, np.int64)
            n, n_words = sums.copy(), None
            for crc, start, end in _features(words, batch, 1, longest):
                upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[crc % buckets])])
                has = end > start
                sums[has] += upto[end[has]] - upto[start[has]]
                n += end - start
                n_words = end - start if n_words is None else n_words
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n, sums // np.maximum(n, 1))]], ["doc_id", "n_words", "n_features", "weight"])

    return narrow(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int, scale: int = 1000) -> Column:
    """floor(scale * Gumbel noise) from the first 32 bits of SHA-256 of `seed:id`; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


class Tournament:
    """A winner tree over sorted runs: the least head of all runs is at the root, and after it goes only its own path is played again."""

    def __init__(self):
        self.slots, self.free = 1, [0]
        self.tree: list[tuple | None] = [None, None]
        self.runs: list[Iterator[tuple] | None] = [None]

    @property
    def winner(self) -> tuple | None:
        """(key, slot, row) of the least head, or nothing."""
        return self.tree[1]

    def add(self, run: Iterator[tuple]) -> None:
        """A run of (key, row) in the order of keys."""
        if not self.free:
            self.free = list(range(self.slots, 2 * self.slots))
            leaves = self.tree[self.slots :] + [None] * self.slots
            self.runs += [None] * self.slots
            self.slots *= 2
            self.tree = [None] * self.slots + leaves
            for at in range(self.slots - 1, 0, -1):
                self._play(at)
        slot = self.free.pop()
        self.runs[slot] = run
        self._next(slot)

    def pop(self) -> tuple:
        """The least row; its run's next head takes its place."""
        _, slot, row = self.tree[1]
        self._next(slot)
        return row

    def _play(self, at: int) -> None:
        a, b = self.tree[2 * at], self.tree[2 * at + 1]
        self.tree[at] = b if a is None else a if b is None or a[:2] <= b[:2] else b

    def _next(self, slot: int) -> None:
        head = next(self.runs[slot], None)
        if head is None:
            self.runs[slot] = None
            self.free.append(slot)
        at = slot + self.slots
        self.tree[at] = None if head is None else (head[0], slot, head[1])
        while at > 1:
            at //= 2
            self._play(at)


def _key(score: int, doc_id: object) -> tuple:
    return (-score, doc_id is None, 0 if doc_id is None else doc_id)


def ranges(histogram: dict[int, int], draws: int, per_range: int) -> tuple[list[int], list[int]]:
    """(lowest score, rows above) of each range of scores that the draws reach, from the highest score down."""
    lowest, above, seen, here = [], [], 0, 0
    for score in sorted(histogram, reverse=True):
        if seen >= draws:
            break
        if not here:
            lowest.append(score)
            above.append(seen)
        lowest[-1] = score
        seen, here = seen + histogram[score], here + histogram[score]
        here = 0 if here >= per_range else here
    return lowest, above


def ranked_draw(scored: DataFrame, draws: int, histogram: dict[int, int], least_range: int = LEAST_RANGE) -> tuple[DataFrame, int]:
    """(rows of the draw's scores with their rank, lowest such score); ties of the last score beyond the draws have rank null.

    scored: (doc_id, n_features, weight, score) of eligible rows; histogram: how many of them each score has. Ties go to the smaller id, null ids last.
    """
    spark, kind = scored.sparkSession, dict(scored.dtypes)["doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest, above = ranges(histogram, draws, min(MOST_RANGE, max(least_range, draws // (2 * parts))))
    bounds = np.array([-x for x in lowest], np.int64)
    names = ["doc_id", "n_features", "weight", "score"]
    row = f"struct<doc_id:{kind},n_features:long,weight:long,score:long>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted run as blocks of one range each."""
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.searchsorted(bounds, -batch.column("score").to_numpy())
            stops = np.union1d(np.flatnonzero(np.diff(at)) + 1, np.arange(BLOCK, batch.num_rows, BLOCK))
            starts = np.concatenate([np.zeros(1, np.int64), stops]).astype(np.int64)
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            rows = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([batch.column(x) for x in names], names))
            heads = pa.array(starts)
            yield pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), batch.column("score").take(heads), batch.column("doc_id").take(heads), rows], ["range", "head_score", "head_id", "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, place, out, shape = Tournament(), None, 0, [], None

        def one() -> None:
            nonlocal place
            place += 1
            out.append((*tree.pop(), place if place <= draws else None))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], shape), *[pa.array(x, pa.int64()) for x in columns[1:]]], [*names, "rank"])

        def block(rows: list[dict]) -> Iterator[tuple]:
            return ((_key(r["score"], r["doc_id"]), tuple(r.values())) for r in rows)

        for batch in batches:
            shape = batch.column("head_id").type
            for k in range(batch.num_rows):
                number, head = batch.column("range")[k].as_py(), _key(batch.column("head_score")[k].as_py(), batch.column("head_id")[k].as_py())
                while tree.winner and (number != now or tree.winner[0] < head):
                    one()
                    if len(out) == BLOCK:
                        yield batch_of(out)
                        out = []
                if number != now:
                    now, place = number, above[number]
                tree.add(block(batch.column("block")[k].as_py()))
        while tree.winner:
            one()
            if len(out) == BLOCK:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    last = lowest[-1]
    runs = scored.select(*names).where(F.col("score") >= last).sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
    blocks = runs.mapInArrow(cut, f"range int, head_score long, head_id {kind}, block array<{row}>")
    met = blocks.repartition(len(lowest), "range").sortWithinPartitions("range", F.desc("head_score"), F.asc_nulls_last("head_id"))
    return met.mapInArrow(merge, f"doc_id {kind}, n_features long, weight long, score long, rank long"), last


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", *, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = 7, buckets: int = BUCKETS, longest: int = LONGEST, least_range: int = LEAST_RANGE) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each input row: floor(percent * N / 100) of the N with enough words are drawn and ranked from 1.

    Null and empty texts have no features and weight 0, and are never drawn. Rows with one id and equal scores take ranks next to each other; null ids come after
    all others of their score, under the noise of an empty id. An empty target leaves the smoothed shares alone; an empty table gives an
    empty result. Other columns are ignored. A score holds 0.04% of rows of equal weight at most, if ids differ, so ranges
    end close to their size; rows that repeat one id share a score and meet in one task, block by block.
    """
    gain = gains(bucket_counts(docs, text_col, buckets=buckets, longest=longest), bucket_counts(target, target_col, buckets=buckets, longest=longest))
    weighed = weights(docs, gain, id_col, text_col, longest=longest)
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    eligible = F.col("n_words") >= least_words
    # One row a score: whole numbers between the least and the greatest gain plus noise of 32 bits, whatever the rows.
    histogram = {r.score: r.n for r in scored.where(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()}
    draws = percent * sum(histogram.values()) // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not draws:
        return scored.select(*columns, unranked)
    drawn, last = ranked_draw(scored.where(eligible), draws, histogram, least_range)
    rest = scored.where(~eligible | (F.col("score") < last)).select(*columns, unranked)
    return drawn.unionByName(rest)

"""Near copies by similarity of shingles: wide SimHash fingerprints propose, the shingle sets decide.

Two texts whose shingle sets have Jaccard similarity s have a cosine of 2s / (1 + s), so their fingerprints are expected to
differ in acos(cosine) / pi of the bits: for 0.8 and 256 bits that is 38. Candidates are pairs that differ in up to ERRORS standard
errors more (55), and a candidate is a link only if the Jaccard similarity of the two texts' shingle sets reaches the threshold.

The index has many tables, each keyed by bits of its own choice among the 256. Both numbers follow from the count of fingerprints, as
for embeddings: a key is so long that a bucket holds about FULL unrelated fingerprints, and there are so many tables that
a pair at the threshold is a candidate with probability RECALL, at every size. The keys are bit samples: a budget of 55
of 256 bits leaves no segment of a useful length free of differences for certain. Inside a bucket the pigeonring filter prunes: the four
words of a fingerprint are the ring's segments, and only pairs with a chain that stays within its proportional
budgets are counted in full.

A pair counts in the first table where it meets. The candidates of a bucket form a graph. Its small components list their pairs, which a join
with the shingle sets decides. Of a component with more than FEW members no pair is listed: each member names
the component's root, and such crowds, joined over all tables, meet once, with their shingle sets: a task holds an inverted index from
shingles to members and counts what a text shares with all of them at once. Crowds of more than SHINGLES shingles are first
compared with a few of their members, which joins a large group of near copies in one pass; what stays outside of that group
meets itself and the group in blocks, two by two in tasks of their own. Buckets of more than BLOCK fingerprints are treated alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, materialize, narrow, slices
from annolens.llm.components import components
from annolens.llm.simhash import SEED, fingerprints, hamming, shingle_spans

WIDTH = 4
SIZE = 5
SIMILARITY = 0.8
RECALL = 0.97
#: Standard errors of the distance at the threshold that a candidate may lie beyond it.
ERRORS = 3.0
FULL = 2048
BLOCK = 8192
#: Members of a component of candidates whose pairs are listed.
FEW = 4
#: Shingles of a crowd that one task holds.
SHINGLES = 1 << 20
#: Members of a crowd or an overfull bucket that all others are compared with first.
PIVOTS = 4
WORDS = [f"f{k}" for k in range(WIDTH)]


def budget(similarity: float, bits: int, errors: float = 0.0) -> int:
    """Differing bits that are expected at a Jaccard similarity, and so many standard errors more."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(bits * share + errors * math.sqrt(bits * share * (1 - share)))


@cache
def found(similarity: float, bits: int, most: int, length: int, tables: int) -> float:
    """Probability that a pair differs in `most` bits at most and shares the key of one table."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    total = 0.0
    for d in range(most + 1):
        met = math.comb(bits - d, length) / math.comb(bits, length)
        total += math.comb(bits, d) * share**d * (1 - share) ** (bits - d) * (1 - (1 - met) ** tables)
    return total


def shape_of(count: int, similarity: float, recall: float, bits: int, most: int) -> tuple[int, int]:
    """(bits of a key, tables) for so many fingerprints."""
    length = max(4, min(32, math.ceil(math.log2(max(2, count) / FULL))))
    tables = 1
    while found(similarity, bits, most, length, tables) < min(recall, 0.999 * found(similarity, bits, most, 0, 1)):
        tables += 1
    return length, tables


@cache
def places(bits: int, length: int, tables: int) -> np.ndarray:
    """(tables, length): the bits that make each table's key."""
    random = np.random.default_rng([SEED, bits, length])
    return np.stack([np.sort(random.permutation(bits)[:length]) for _ in range(tables)])


def keys_of(words: np.ndarray, length: int, tables: int) -> np.ndarray:
    """(n, tables) integers, no two tables with one in common."""
    every = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    at = places(every.shape[1], length, tables)
    return np.stack([every[:, p] @ (1 << np.arange(length, dtype=np.int64)) for p in at], axis=1) + (np.arange(tables, dtype=np.int64) << 40)


def masks(bits: int, length: int, tables: int) -> np.ndarray:
    """(tables, words): the keys' bits set."""
    every = np.zeros((tables, bits), np.uint8)
    np.put_along_axis(every, places(bits, length, tables), 1, axis=1)
    return np.packbits(every, axis=1).view(">u8").astype(np.uint64)


def _words(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy() for k in range(WIDTH)], axis=1).view(np.uint64)


class Roots:
    """Union-find over 0..size-1; the root of a set is its least member."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y

    def every(self) -> np.ndarray:
        """The root of each index."""
        up = np.array(self.up, np.int64)
        while (up[up] != up).any():
            up = up[up]
        return up


def within(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that differ in `most` bits or fewer, by pigeonring: from some word on, chains keep their budgets."""
    differ = [np.bitwise_count(left[:, None, k] ^ right[None, :, k]) for k in range(WIDTH)]
    found = []
    for start in range(WIDTH):
        i, j = np.nonzero(differ[start] <= most // WIDTH)
        total = differ[start][i, j].astype(np.int64)
        for length in range(2, WIDTH + 1):
            total += differ[(start + length - 1) % WIDTH][i, j]
            fine = total * WIDTH <= length * most
            i, j, total = i[fine], j[fine], total[fine]
        found.append(i * len(right) + j)
    pairs = np.unique(np.concatenate(found))
    return pairs // max(1, len(right)), pairs % max(1, len(right))


def _candidates(rows: dict[str, np.ndarray], most: int, mask: np.ndarray) -> list[tuple[int, int, bool]]:
    """(u, v, crowd) of one bucket's rows or one pair of its blocks."""
    words, now, rep = rows["words"], rows["now"], rows["rep"]
    both = bool(rows["side"].any())
    a = np.flatnonzero(rows["side"] == 0)
    b = np.flatnonzero(rows["side"] == 1) if both else a
    earlier = mask[: int(rows["key"][0]) >> 40]
    roots, every, listed = Roots(len(rep)), np.arange(len(rep)), []
    for at in range(0, len(b), 256):
        mine = b[at : at + 256]
        against = a if both else a[: at + len(mine)]
        i, j = within(words[mine], words[against], most)
        i, j = mine[i], against[j]
        fine = (now[i] != now[j]) & (both | (j < i))
        i, j = i[fine], j[fine]
        for m in earlier:
            if not len(i):
                break
            fine = ((words[i] ^ words[j]) & m).any(axis=1)
            i, j = i[fine], j[fine]
        if not len(i):
            continue
        for x in np.unique(i * len(rep) + every[j]).tolist():
            roots.join(*divmod(x, len(rep)))
        every = roots.every()
        sizes = np.bincount(every, minlength=len(rep))
        # a pair of a component that is large already is not listed, whatever follows
        small = sizes[every[i]] <= FEW
        listed += zip(i[small].tolist(), j[small].tolist(), strict=True)
    sizes = np.bincount(every, minlength=len(rep))
    crowd = np.flatnonzero((sizes[every] > FEW) & (every != np.arange(len(rep))))
    few = [(int(rep[x]), int(rep[y]), False) for x, y in listed if sizes[every[x]] <= FEW]
    return few + [(int(rep[x]), int(rep[every[x]]), True) for x in crowd]


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, of batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        names = [table.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in names], axis=0)) + 1
        # the last group may go on in the next batch
        for x, y in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            yield table.slice(x, y - x)
        rest = table.slice(int(cuts[-1]) if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _propose(batches: Iterator[pa.RecordBatch], most: int, length: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, meet, side, rep, now, f0..) sorted by key and meet -> candidates (u, v, crowd)."""
    mask, names = masks(64 * WIDTH, length, tables), ("key", "meet", "side", "rep", "now")
    for table in _grouped(batches, ("key", "meet")):
        if table.num_rows > 1:
            rows = {k: table.column(k).to_numpy() for k in names}
            rows["words"] = np.stack([table.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
            if found := _candidates(rows, most, mask):
                u, v, crowd = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(crowd, pa.bool_())], ["u", "v", "crowd"])


def _deal(rows: DataFrame, key: str, block: int, weight: str) -> DataFrame:
    """Rows (key, now, ...) with the meetings of each key's groups: meet and side, in blocks of `block` in the column `weight`.

    The largest class of a group lies in `a` blocks, all others in `r`: these meet two by two, as numbers i * r + j with
    i <= j, and each block of the class, as r * r + i * r + j. A row on side 1 meets those on side 0. A group that fits in one block meets as a whole.
    """
    each = rows.groupBy(key, "now").agg(F.sum(weight).alias("part"))
    held = each.groupBy(key).agg(F.max_by("now", F.struct("part", "now")).alias("home"), F.max("part").alias("a"), F.sum("part").alias("all"))
    held = held.withColumns({"r": F.col("all") - F.col("a"), "whole": F.col("all") <= block})
    held = held.select(key, "home", "whole", *[F.when(F.col("whole"), F.lit(int(k == "r"))).otherwise(F.ceil(F.col(k) / block)).cast("int").alias(k) for k in "ar"])
    held = materialize(held.where("r > 0"), "near-held")
    placed = rows.join(held, key).withColumn("inside", F.expr("not whole and now = home")).withColumn("mine", F.expr("cast(pmod(xxhash64(rep), if(inside, a, r)) as int)"))
    among = "transform(sequence(0, r - 1), o -> named_struct('meet', cast(least(mine, o) as long) * r + greatest(mine, o), 'side', if(o < mine, 1, 0)))"
    across = "if(a > 0, transform(sequence(0, greatest(a, 1) - 1), o -> named_struct('meet', cast(r as long) * r + o * r + mine, 'side', 1)), array())"
    within_ = "transform(sequence(0, r - 1), o -> named_struct('meet', cast(r as long) * r + mine * r + o, 'side', 0))"
    meets = placed.withColumn("at", F.explode(F.expr(f"if(inside, {within_}, concat({among}, {across}))")))
    return meets.select("at.meet", "at.side", *rows.columns)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, shingles): the distinct shingles of each row (rep, text) as XXH64 hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = []
            for text in byte_texts(batch.column(1)):
                joined, starts, ends = shingle_spans(text, size)
                sets.append(np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def shared_links(sets: list[np.ndarray], side: np.ndarray, now: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span the classes of a meeting's texts; texts on side 1, if there are any, meet those on side 0 alone.

    Pairs of one class (now) are not looked at; a link between texts that others have joined already is left out.
    """
    both = bool(side.any())
    a = np.flatnonzero(side == 0)
    asking = np.flatnonzero(side == 1) if both else a
    if not len(a) or not len(asking):
        return []
    sizes = np.array([len(sets[k]) for k in range(len(sets))])
    _, local = np.unique(np.concatenate([sets[k] for k in a] + [sets[k] for k in asking] * both), return_inverse=True)
    cuts = np.cumsum([0, *sizes[a], *(sizes[asking] if both else ())])
    owners = np.repeat(np.arange(len(a)), sizes[a])
    order = np.argsort(local[: len(owners)], kind="stable")
    starts = np.searchsorted(local[: len(owners)][order], np.arange(local.max(initial=-1) + 2))
    owners = owners[order]
    roots, first, found = Roots(len(sets)), {}, []
    for k, c in enumerate(now.tolist()):
        roots.join(k, first.setdefault(c, k))
    shift = len(a) if both else 0

    def ask(k: int) -> None:
        u = int(asking[k])
        terms = local[cuts[shift + k] : cuts[shift + k + 1]]
        if len(terms):
            spans = [owners[x:y] for x, y in zip(starts[terms].tolist(), starts[terms + 1].tolist(), strict=True)]
            common = np.bincount(np.concatenate(spans), minlength=len(a))
            hits = np.flatnonzero(common / (sizes[u] + sizes[a] - common) >= similarity)
        else:
            hits = np.flatnonzero(sizes[a] == 0)
        for v in a[hits].tolist():
            if v != u and roots.join(u, v):
                found.append((u, v))

    if both:
        for k in range(len(asking)):
            ask(k)
        return found
    asked = set(range(0, len(asking), max(1, len(asking) // 16)))
    for k in asked:
        ask(k)
    # A pair with one end in the largest class is found from its other end.
    every = roots.every()[asking]
    home = np.bincount(every).argmax()
    for k in np.flatnonzero(every != home).tolist():
        if k not in asked:
            ask(k)
    return found


def _decide(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (group, meet, side, rep, now, shingles) sorted by group and meet -> links (u, v)."""
    for table in _grouped(batches, ("group", "meet")):
        rep, column = table.column("rep").to_numpy(), table.column("shingles").combine_chunks()
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        sets = [values[x:y] for x, y in zip(offsets, offsets[1:], strict=False)]
        if found := shared_links(sets, table.column("side").to_numpy(), table.column("now").to_numpy(), similarity):
            u, v = (rep[np.array(k)] for k in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


#: Texts whose shingle sets are asked for, up to which their ids are broadcast; beyond, all texts are shuffled to meet them.
FEW_TEXTS = 500_000


class _Search:
    """What the steps share: texts (doc_id, mark, text), the row (rep, doc_id, mark) of each distinct fingerprint, and the threshold."""

    def __init__(self, texts: DataFrame, firsts: DataFrame, size: int, similarity: float):
        self.texts, self.firsts, self.size, self.similarity = texts, firsts, size, similarity

    def sets_of(self, reps: DataFrame) -> DataFrame:
        """(rep, shingles), one row for each rep."""
        asked = materialize(self.firsts.join(reps.select("rep").distinct(), "rep").select("rep", F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark")), "near-asked")
        same = F.col("mark").eqNullSafe(F.col("its_mark")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
        met = self.texts.join(F.broadcast(asked) if asked.count() <= FEW_TEXTS else asked, same).select("rep", "text")
        return materialize(shingle_sets(met.groupBy("rep").agg(F.any_value("text").alias("text")), self.size), "near-sets")

    def similar(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (u, v) whose shingle sets are similar enough."""
        left, right = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(x)) for k, x in (("u", "x"), ("v", "y")))
        shared = F.size(F.array_intersect("x", "y"))
        alike = F.coalesce(shared / F.nullif(F.size("x") + F.size("y") - shared, F.lit(0)), F.lit(1.0))
        return materialize(pairs.join(left, "u").join(right, "v").where(alike >= self.similarity).select("u", "v"), "near-similar")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("rep"))


def _pairs(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near-pairs")


def _now(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (rep, ...) with their class by these links."""
    joined = components(edges, "near-links").select(F.col("node").alias("rep"), F.col("component").alias("now"))
    return rows.drop("now").join(joined, "rep", "left").withColumn("now", F.coalesce("now", "rep"))


def _pivots(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, pivot): a few rows of each group, by hash."""
    chosen = rows.groupBy(key).agg(*[F.min_by(F.struct("rep", *columns), F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    return materialize(chosen.select(key, F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("pivot")), "near-pivots")


def _crowds(members: DataFrame, sets: DataFrame, search: _Search, shingles: int) -> DataFrame:
    """Links (u, v) inside of crowds (rep, group): whole crowds in a task each, large ones in blocks."""
    rows = materialize(members.join(sets.select("rep", F.size("shingles").alias("held")), "rep").withColumn("now", F.col("rep")), "near-crowd")
    large = materialize(rows.groupBy("group").agg(F.sum("held").alias("all")).where(F.col("all") > shingles).select("group"), "near-large")
    links = None
    if not large.isEmpty():
        inside = rows.join(large, "group")
        met = inside.join(_pivots(inside, "group"), "group").where("rep <> pivot.rep").select(F.col("rep").alias("u"), F.col("pivot.rep").alias("v"))
        links = search.similar(_pairs(met), sets)
        rows = materialize(_now(links, rows), "near-crowd")
    dealt = _deal(rows, "group", shingles, "held").join(sets, "rep").select("group", "meet", "side", "rep", "now", "shingles")
    dealt = dealt.repartition("group", "meet").sortWithinPartitions("group", "meet", "side", "rep")
    similarity = search.similarity
    found = materialize(dealt.mapInArrow(lambda batches: _decide(batches, similarity), "u long, v long"), "near-found")
    return found if links is None else found.unionByName(links)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = SIZE, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BLOCK, shingles: int = SHINGLES, shape: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, mark, component_id, kept), one row for each input row.

    Words are runs of non-space bytes with A-Z in lower case; shingles are `size` words (each counts once), of shorter texts the whole sequence.
    Texts whose shingle sets have a Jaccard similarity of `similarity` or more are linked. A link is found with probability
    `recall` at the threshold, and more surely above. component_id is the least doc_id
    reachable, null if there are null ids alone. Null and wordless texts are alike. mark is a hash of the text, which tells rows of one id apart: kept says that a row
    has the id and the mark of its class's first row (null ids last, then the least id, then the least mark), so repeated rows share
    their decision. An empty table gives an empty result. Other columns are ignored. Ids may be of any type that orders.
    shape sets (bits of a key, tables), which follow from the count of fingerprints if it is not given.
    """
    texts = narrow(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    prints = materialize(fingerprints(texts.select(F.struct("doc_id", "mark").alias("doc_id"), "text"), size, WIDTH, distinct=True).select("doc_id.*", *WORDS), "near-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    distinct = materialize(prints.groupBy(*WORDS).agg(first).withColumn("rep", F.monotonically_increasing_id()), "near-distinct")
    search = _Search(texts, distinct.select("rep", "first.doc_id", "first.mark"), size, similarity)
    most = budget(similarity, 64 * WIDTH, ERRORS)
    length, tables = shape or shape_of(distinct.count(), similarity, recall, 64 * WIDTH, most)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keys = keys_of(_words(batch, 1), length, tables)
            for k in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])), *batch.columns], ["key", *batch.schema.names])

    keyed = distinct.select("rep", *WORDS).mapInArrow(encode, "key long, rep long, " + ", ".join(f"{w} long" for w in WORDS))
    over = materialize(keyed.groupBy("key").count().where(F.col("count") > bucket).select("key"), "near-over")
    crowded = not over.isEmpty()
    edges = None

    def proposed(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("key", "meet", "side", "rep", "now", *WORDS)
        return materialize(dealt.mapInArrow(lambda batches: _propose(batches, most, length, tables), "u long, v long, crowd boolean"), "near-met")

    usual = keyed.join(over, "key", "left_anti") if crowded else keyed
    usual = usual.repartition("key").sortWithinPartitions("key", "rep")
    met = proposed(usual.withColumns({"meet": F.lit(0).cast("long"), "side": F.lit(0), "now": F.col("rep")}))
    if crowded:
        inside = keyed.join(over, "key")
        near = inside.join(_pivots(inside, "key", *WORDS), "key").where((hamming(WORDS, [f"pivot.{w}" for w in WORDS]) <= most) & (F.col("rep") != F.col("pivot.rep")))
        near = _pairs(near.select(F.col("rep").alias("u"), F.col("pivot.rep").alias("v")))
        edges = search.similar(near, search.sets_of(_ends(near)))
        now = materialize(_now(edges, distinct.select("rep")), "near-now")
        dealt = _deal(inside.join(now, "rep").withColumn("one", F.lit(1)), "key", bucket, "one")
        met = met.unionByName(proposed(dealt.repartition("key", "meet").sortWithinPartitions("key", "meet", "side", "rep")))
    pairs, crowd = _pairs(met.where("not crowd")), met.where("crowd").select("u", "v")
    members = materialize(components(crowd, "near-crowds").select(F.col("node").alias("rep"), F.col("component").alias("group")), "near-members")
    sets = search.sets_of(_ends(pairs).unionByName(members.select("rep")))
    new = search.similar(pairs, sets).unionByName(_crowds(members, sets, search, shingles))
    edges = new if edges is None else edges.unionByName(new)
    classes = materialize(_now(edges, distinct.select("rep", "first", *WORDS)), "near-classes")
    lowest = materialize(classes.groupBy("now").agg(F.min("first").alias("lowest")), "near-lowest")
    named = materialize(classes.join(lowest, "now").select(*WORDS, "lowest"), "near-named")
    return prints.join(named, WORDS).select(
        "doc_id",
        "mark",
        F.col("lowest.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("mark") == F.col("lowest.mark"))).alias("kept"),
    )

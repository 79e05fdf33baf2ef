"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is turned by fixed random rotations and keeps the signs: its binary code. Beside the code goes a correction
factor, the inner product of the vector with its own code. The inner product of another vector with the code, divided by the factor, is
an unbiased estimate of the two vectors' cosine, with an error bound that shrinks with the square root of the
dimension. Pairs whose estimate stays below the threshold even with the bound added are ruled out; all others are recomputed
exactly, in double precision.

Candidates are vectors that share one of `tables` keys, each a run of bits of the codes. Both numbers follow from the
count of vectors: a key is so long that a bucket holds about BUCKET unrelated vectors, and there are so many keys that a pair
at the threshold shares one with probability RECALL. A pair counts in the first table where it meets, so
no pair is ever listed: tasks hold a tile of pairs at a time and return, for each vector, how many it links to and the root of its links there. Equal vectors
are one class from the start. Tables are dealt in rounds, so that the disk holds the shuffle of a few at a time. A bucket of more than BLOCK classes is cut into blocks that meet two by two in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import materialize, remove, slices
from annolens.llm.components import components

THRESHOLD = 0.9
RECALL = 0.99
BUCKET = 512
BLOCK = 4096
#: Vectors a side of a tile, whose pairs are estimated at once.
TILE = 1024
#: Numbers that a recomputation holds at once, a side: vectors' components or keys of pairs.
HELD = 1 << 22
#: Share of a tile's pairs from which all of them are multiplied at once; products this close to the threshold are taken again one by one.
DENSE, CLOSE = 1 / 16, 1e-9
#: Rows that are dealt at once, one for each class and table, and the tables that are dealt at once however many that is.
ROUND, ROUND_TABLES = 1 << 20, 2
#: Overfull buckets up to which their keys are broadcast.
FEW_BUCKETS = 500_000
#: Standard errors in the bound of an estimate.
ERRORS = 4.0
SEED = 20240521


@cache
def rotation(dimension: int, number: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dimension, number]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def shape_of(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors."""
    same = 1 - math.acos(min(1.0, threshold)) / math.pi
    bits = max(0, min(30, math.ceil(math.log2(max(1, count) / BUCKET))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)) if same < 1 and bits else 1


def signs(units: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits) booleans: the signs under as many rotations as that takes."""
    dimension = units.shape[1]
    turned = [units @ rotation(dimension, k) for k in range(max(1, -(-bits // dimension)))]
    return (np.hstack(turned) > 0)[:, :bits]


def keys_of(units: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(n, tables) integers."""
    code = signs(units, bits * tables).reshape(len(units), tables, bits)
    return code @ (1 << np.arange(bits, dtype=np.int64))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by a power of two before, which is exact, so that squares of huge components stay finite."""
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def code_of(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction factors): what is stored of each vector."""
    dimension = units.shape[1]
    turned = units @ rotation(dimension, 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(dimension)


def links(units: np.ndarray, code: np.ndarray, factor: np.ndarray, a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors with a cosine of threshold or more: estimated from the first one's code and factor, then exactly.

    One index is from a and one from b, or both are from a, each pair once. However many there are, few are held at a time.
    """
    dimension = units.shape[1]
    root = math.sqrt(dimension)
    plus = (2.0 * np.unpackbits(code, axis=1, count=dimension).astype(np.float32) - 1) / np.float32(root)
    turned = (units @ rotation(dimension, 0)).astype(np.float32)
    # estimate + bound >= threshold, multiplied by the factor
    least = (threshold * factor - ERRORS * np.sqrt(np.maximum(0.0, 1 - factor**2)) / math.sqrt(max(1, dimension - 1))).astype(np.float32)
    step = max(1, HELD // dimension)
    right = a if b is None else b
    for at in range(0, len(a), TILE):
        mine = a[at : at + TILE]
        for to in range(at if b is None else 0, len(right), TILE):
            theirs = right[to : to + TILE]
            likely = plus[mine] @ turned[theirs].T >= least[mine][:, None]
            if b is None and at == to:
                likely = np.triu(likely, 1)
            hits = np.flatnonzero(likely)
            dense = len(hits) > DENSE * likely.size
            every = (units[mine] @ units[theirs].T).ravel() if dense else None
            for k in range(0, len(hits), step):
                part = hits[k : k + step]
                if dense:
                    product = every[part]
                    part, product = part[product >= threshold - CLOSE], product[product >= threshold - CLOSE]
                i, j = mine[part // len(theirs)], theirs[part % len(theirs)]
                again = np.flatnonzero(product < threshold + CLOSE) if dense else slice(None)
                sure = np.ones(len(i), bool)
                sure[again] = np.einsum("ij,ij->i", units[i[again]], units[j[again]]) >= threshold
                if sure.any():
                    yield i[sure], j[sure]


def roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over the pairs."""
    root = np.arange(size)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(rows: dict, threshold: float) -> tuple[list, list, list] | None:
    """(vec_id, links, root) of one bucket's rows or one pair of its blocks."""
    side, table = rows["side"], rows["table"]
    units = unit(rows["embedding"].astype(np.float64))
    a, b = (np.flatnonzero(side == 0), None) if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    if not len(a) or (b is not None and not len(b)):
        return None
    weight, count, root = rows["n"], np.zeros(len(side), np.int64), np.arange(len(side))
    step = max(1, HELD // max(1, table))
    for left, right in links(units, rows["code"], rows["factor"], a, b, threshold):
        for k in range(0, len(left), step):
            i, j = left[k : k + step], right[k : k + step]
            if table:
                first = ~(rows["keys"][i, :table] == rows["keys"][j, :table]).any(axis=1)
                i, j = i[first], j[first]
            count += (np.bincount(i, weight[j], len(side)) + np.bincount(j, weight[i], len(side))).astype(np.int64)
            u, v = root[i], root[j]
            apart = u != v
            if apart.any():
                root = roots(len(side), u[apart], v[apart])[root]
    some = np.flatnonzero(count)
    if not len(some):
        return None
    ids = rows["rep"]
    return ids[some], count[some], ids[root[some]]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), len(flat) // len(lists))


def _run(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket, or pair of blocks, is compared once it is complete."""
    rest: pa.Table | None = None

    def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
        place = [table.column(k).to_numpy() for k in ("table", "bucket", "pair", "size")]
        columns = {k: table.column(k).to_numpy() for k in ("table", "side", "n", "rep", "factor")}
        codes = table.column("code").to_pylist()
        lists = {k: table.column(k).combine_chunks() for k in ("embedding", "keys")}
        change = np.flatnonzero(np.any([p[1:] != p[:-1] for p in place], axis=0)) + 1
        cuts = [0, *change.tolist(), table.num_rows]
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            rows = {k: v[a] if k == "table" else v[a:b] for k, v in columns.items()} | {k: _matrix(x.slice(a, b - a)) for k, x in lists.items()}
            got = _compare(rows | {"code": np.frombuffer(b"".join(codes[a:b]), np.uint8).reshape(b - a, -1)}, threshold)
            if got:
                for k in range(3):
                    out[k].append(got[k])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[k]), pa.int64()) for k in range(3)], ["rep", "links", "root"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = [table.column(k).to_numpy() for k in ("table", "bucket", "pair", "size")]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
        # the last bucket may go on in the next batch
        start = int(change[-1]) + 1 if len(change) else 0
        if start:
            yield from results(table.slice(0, start))
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield from results(rest)


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each input row.

    n_links counts the other rows that a row links with directly, at a cosine of `threshold` or more in double precision;
    component_id is the least vec_id reachable. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do rows with a null id; they are their own component. Vectors of different lengths do
    not link. Rows that repeat an id are rows like others. An empty table gives an empty result. Ids are whole numbers; components of
    any other type than float are taken as doubles. Other columns are ignored.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good, other = rows.where(usable), rows.where(~usable)
    classes = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes", clear=True)
    total = classes.count()
    bits, tables = shape_of(total, threshold, recall)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TILE):
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            keys = np.zeros((len(sizes), tables), np.int64)
            flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(sizes)))
            codes, factors = [b""] * len(sizes), np.zeros(len(sizes))
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                units = unit(np.stack([flat[at[k] : at[k] + size] for k in mine]))
                keys[mine] = keys_of(units, bits, tables)
                packed, factors[mine] = code_of(units)
                for k, code in zip(mine.tolist(), packed, strict=True):
                    codes[k] = code.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables), pa.array(keys.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([column, batch.column(1), batch.column(2), lists, pa.array(codes, pa.binary()), pa.array(factors)], ["embedding", "rep", "n", "keys", "code", "factor"])

    coded = materialize(classes.mapInArrow(encode, f"embedding {kind}, rep long, n long, keys array<int>, code binary, factor double"), "codes")
    remove(vectors.sparkSession, classes)
    # The buckets that need more than one block are few, and counted on narrow rows.
    keyed = coded.select(F.size("embedding").alias("size"), F.posexplode("keys").alias("table", "bucket"))
    held = keyed.groupBy("table", "bucket", "size").agg(F.count("*").alias("held")).where(F.col("held") > block)
    over = materialize(held.select("table", "bucket", "size", F.ceil(F.col("held") / block).cast("int").alias("blocks")), "over", clear=True)
    few = over.count() <= FEW_BUCKETS
    # Block pairs (i, j), i <= j, as i * blocks + j: a row of block m meets every block, on side 1 if it is the first and 2 if it is the second, 0 within its own.
    pairs = F.expr("transform(sequence(0, blocks - 1), o -> named_struct('pair', cast(least(mine, o) as long) * blocks + greatest(mine, o), 'side', case when mine < o then 1 when mine > o then 2 else 0 end))")

    def meet(first: int, upto: int) -> DataFrame:
        """The links of some tables. A row takes along the keys of the tables before its own."""
        places = F.posexplode(F.slice("keys", first + 1, upto - first)).alias("place", "bucket")
        spread = coded.select("*", F.size("embedding").alias("size"), places).withColumn("table", F.col("place") + first)
        joined = spread.join(F.broadcast(over) if few else over, ["table", "bucket", "size"], "left")
        placed = joined.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = placed.withColumn("meet", F.explode(pairs)).select("table", "bucket", "size", "meet.pair", "meet.side", "n", "rep", "embedding", F.slice("keys", 1, F.col("table")).alias("keys"), "code", "factor")
        dealt = dealt.repartition("table", "bucket", "size", "pair").sortWithinPartitions("table", "bucket", "size", "pair", "side", "rep")
        return materialize(dealt.mapInArrow(lambda batches: _run(batches, threshold), "rep long, links long, root long"), "links", clear=True)

    # Some tables after others: a round's shuffle files go before the next round writes its own.
    some = max(ROUND_TABLES, ROUND // max(1, total))
    met = reduce(DataFrame.unionByName, [meet(k, min(tables, k + some)) for k in range(0, tables, some)])

    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(met.select(F.col("rep").alias("u"), F.col("root").alias("v")), "embedding-links")
    member = coded.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    # A table of its own, so that the join can split a vector that many rows hold.
    member = materialize(member.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "members", clear=True)
    remove(vectors.sparkSession, coded)
    # The hash comes first, so that sorts and comparisons seldom reach the vectors.
    result = good.withColumn("hash", F.xxhash64("embedding")).join(member.withColumn("hash", F.xxhash64("embedding")), ["hash", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""SimHash near-dedup with the pigeonring filter.

A fingerprint of W * 64 bits is the bitwise majority over the hashes of a document's word shingles. Its bits form a ring
of m segments. If two fingerprints differ in at most t bits, some segment of the ring starts a chain all of whose
prefixes, of l = 1..m segments, hold at most l * t / m differences. While l * t < m that budget is zero, so the first
c = ceil(m / t) - 1 segments of such a chain agree exactly: they are the index key, and the longer prefixes prune
candidates before the full Hamming check.

Only distinct fingerprints are indexed. A key shared by more than `bucket` of them (very many near copies) is not
paired up: fingerprints of such keys meet at their midpoints instead. Two fingerprints at distance two or less, and only
those, share a value that is at most one bit away from both; each value has at most 65 such neighbours, so that route is linear in
the number of fingerprints and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolens.llm.base import byte_texts, materialize, narrow, slices
from annolens.llm.components import components

SEED = 42
BUCKET = 64
#: Shingles whose bits are counted at once: bounds the memory that one very long text takes.
CHUNK = 1 << 16


def shingle_spans(text: bytes, size: int) -> tuple[bytes, list[int], list[int]]:
    """The space-joined words of a text with A-Z in lower case, and where its shingles start and end in it."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return joined, [0] * bool(words), [len(joined)] * bool(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return joined, starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()


def fingerprint(text: bytes, size: int, width: int = 1, distinct: bool = False) -> bytes:
    """width * 8 bytes, most significant bit first; all zero for a text without words. distinct: each shingle counts once.

    The first 64 bits come from XXH64 with seed 42, each further 64 from an odd multiple of it, mixed.
    """
    joined, starts, ends = shingle_spans(text, size)
    if not starts:
        return bytes(8 * width)
    digest, seed = xxhash.xxh64_digest, SEED
    counts = np.zeros(64 * width, np.int64)
    total = len(starts)
    if distinct:
        places = {joined[a:b]: (a, b) for a, b in zip(starts, ends, strict=True)}
        starts, ends = ([p[k] for p in places.values()] for k in (0, 1))
        total = len(starts)
    for at in range(0, total, CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
        first = np.frombuffer(hashes, ">u8")
        for k in range(width):
            block = first if not k else _mixed(first, k)
            bits = np.unpackbits(block.view(np.uint8)).reshape(-1, 64)
            counts[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > total).tobytes()


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x.astype(">u8")


def fingerprints(docs: DataFrame, size: int, width: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, f0..f{width-1}): the fingerprint of each row as signed 64-bit words."""
    names = [f"f{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = b"".join([fingerprint(x, size, width, distinct) for x in byte_texts(batch.column(1))])
            words = np.frombuffer(prints, ">i8").astype(np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(width))], ["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def hamming(left: list[str], right: list[str]) -> Column:
    total = F.bit_count(F.col(left[0]).bitwiseXOR(F.col(right[0])))
    for a, b in zip(left[1:], right[1:], strict=True):
        total = total + F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    return total


def _bits(name: str, start: int, count: int) -> Column:
    """count bits of a 64-bit word from bit `start`, the most significant bit being 0; the ring closes."""
    x = F.col(name)
    mask = F.lit((1 << count) - 1).cast("long")
    if start + count <= 64:
        return F.shiftrightunsigned(x, 64 - start - count).bitwiseAND(mask)
    rest = start + count - 64
    high = F.shiftrightunsigned(x, 0).bitwiseAND(F.lit((1 << (64 - start)) - 1).cast("long"))
    return F.shiftleft(high, rest).bitwiseOR(F.shiftrightunsigned(x, 64 - rest))


def ring(segments: int) -> list[tuple[int, int]]:
    """(first bit, length) of each segment of a 64-bit ring."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def near_links(prints: DataFrame, distance: int = 2, segments: int = 7, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between distinct 64-bit fingerprints f0 whose components are those of all links at `distance` or less.

    prints holds each fingerprint once. Keys of at most `bucket` fingerprints give every linked pair; those of
    fuller keys are joined through midpoints, which needs a distance of two or less.
    """
    if distance > 2:
        raise ValueError("midpoints reach links of two bits or fewer")
    parts = ring(segments)
    exact = -(-segments // max(1, distance)) - 1 if distance else segments
    keys = []
    for k in range(segments):
        width = sum(parts[(k + j) % segments][1] for j in range(exact))
        keys.append(F.struct(F.lit(k).cast("byte").alias("start"), _bits("f0", parts[k][0], width).alias("chain")))
    keyed = prints.select("f0", F.explode(F.array(*keys)).alias("key")).select("f0", "key.start", "key.chain")
    full = keyed.groupBy("start", "chain").agg(F.count("*").alias("n")).where("n > 1")
    keyed = materialize(keyed.join(full, ["start", "chain"]), "simhash-keys")

    low = keyed.where(F.col("n") <= bucket).select("start", "chain", F.col("f0").alias("u"))
    high = low.withColumnRenamed("u", "v")
    pairs = low.join(high, ["start", "chain"]).where("u < v")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    pairs = pairs.withColumn("differ", differ).where(F.bit_count("differ") <= distance * (segments - 1))
    spread = [F.bit_count(_bits("differ", a, n)) for a, n in parts]
    for k in range(segments):
        total = F.lit(0)
        for size in range(segments):
            total = total + spread[(k + size) % segments]
            if size >= exact:
                pairs = pairs.where((F.col("start") != k) | (total * segments <= (size + 1) * distance))
    near = pairs.where(F.bit_count("differ") <= distance).select("u", "v").distinct()

    crowded = keyed.where(F.col("n") > bucket).select("f0").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("f0").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    middles = crowded.select("f0", F.explode(F.concat(F.array("f0"), flips)).alias("middle"))
    met = middles.groupBy("middle").agg(F.collect_set("f0").alias("all")).where(F.size("all") > 1)  # 65 at most
    through = met.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v").distinct()
    return near.unionByName(through)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3, distance: int = 2, segments: int = 7, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept): near-duplicate classes of one row for each input row.

    Words are runs of non-space bytes with A-Z in lower case, shingles are `size` words (fewer words: the whole
    sequence). Fingerprints at `distance` or fewer differing bits link; component_id is the least doc_id reachable,
    and kept says that it is the row's own. Null and wordless texts have fingerprint zero, which links like any other.
    Rows with a null doc_id get classes like others but never name one; a class of null ids alone has a null
    component_id and keeps its rows. Repeated rows are one document. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(narrow(docs, id_col, text_col), size), "simhash")
    distinct = prints.groupBy("f0").agg(F.min("doc_id").alias("least"))
    joined = components(near_links(distinct.select("f0"), distance, segments, bucket), "simhash-links")
    classes = distinct.join(joined.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "least", F.coalesce("component", "f0").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    # A table of its own, so that the join can split a fingerprint that many rows have.
    member = materialize(classes.join(lowest, "root").select("f0", "component_id"), "simhash-members")
    return prints.join(member, "f0").select(
        "doc_id",
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )

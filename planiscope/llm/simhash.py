"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are compared under structured bit masks. Every bit position gets a random label of r + 1 bits; the mask
of a non-zero vector v keeps the positions whose label has an odd product with v. For any r positions some v is
orthogonal to all their labels, so two fingerprints that differ in at most r bits agree under at least one of the
2**(r + 1) - 1 masks: recall is exactly 1, without an assumption on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, stored, text_slices

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text; see fingerprints."""
    words = text.translate(_LOWER).split()  # bytes.split() splits at exactly the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    size = min(shingle, len(words))
    starts, stops = (ends - lens)[: len(words) - size + 1], ends[size - 1 :]
    counts, digest = np.zeros((8, 256), np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), stops[at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[j] += np.bincount(hashes[:, j], minlength=256)
    ones = (counts @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every whole text, as a signed long.

    A-Z are lowered, words are runs without the six ASCII separators, shingles of `shingle` words count as often as
    they occur; a bit is set if it is in over half of the shingles' hashes. Null, empty and blank texts get zero.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(F.col(id_col).alias("id")).schema.add("fp", "long")
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, buf, offs in text_slices(batch, "text", 1 << 22):
                data, edges = buf.tobytes(), offs.tolist()
                out += [fingerprint(data[a:b], shingle) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], schema=arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, schema)


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """2**(radius + 1) - 1 masks under one of which any two 64-bit values at most `radius` bits apart agree."""
    labels = np.random.default_rng(7919 + level).integers(0, 1 << (radius + 1), 64)
    return [sum(1 << i for i, x in enumerate(labels.tolist()) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Members of one bucket that are compared in one task; larger buckets are covered again on other masks.
BUCKET = 1 << 15


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that connect all those within `radius` bits.

    `fps` has a column fp of distinct values. A bucket's rows are pairs (smallest, other) of each group that hangs
    together inside it, so a bucket gives fewer rows than it has members. Buckets over `bucket` members are dealt
    into the buckets of a further family of masks, again and again: agreement under all masks so far leaves ever
    fewer free bits, until distinct values no longer fill a bucket. No link is lost, since every level covers.
    """
    found, level = None, 0
    rows = fps.select("fp", F.lit(0).cast("long").alias("way"), F.lit(0).cast("long").alias("fixed"))
    while True:
        masks = [_signed(m) for m in covering_masks(radius, level)]
        choice = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks)]))
        rows = rows.select("fp", "way", "fixed", choice.alias("c")).select("fp", (F.col("way") * len(masks) + F.col("c.i")).alias("way"), F.col("fixed").bitwiseOR(F.col("c.m")).alias("fixed"))
        key = F.col("fp").bitwiseAND(F.col("fixed"))
        dealt = rows.repartition(partitions(fps), "way", key).withColumn("key", key).sortWithinPartitions("way", "key")
        out = stored(dealt.mapInArrow(lambda it: _bucket_links(it, radius, bucket), "a long, b long, way long, fixed long"), f"links{level}")
        pairs = out.filter("way is null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        rows = out.filter("way is not null").select(F.col("a").alias("fp"), "way", "fixed")
        if not rows.take(1):
            return found.distinct()
        level += 1


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Links of every bucket of a partition that is sorted by bucket, and the members of buckets that are too large."""
    names = ["a", "b", "way", "fixed"]
    held: list[np.ndarray] = []  # of the bucket that is read: none once it is too large
    size, current = 0, None

    def over(fp: np.ndarray, way: int, fixed: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(np.full(len(fp), way)), pa.array(np.full(len(fp), fixed))], names=names)

    def linked(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _pairs(done)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=names)

    for batch in batches:
        f, way, fixed, key = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fp", "way", "fixed", "key"))
        f = f.view(np.uint64)
        new = np.ones(len(f), bool)
        new[1:] = (way[1:] != way[:-1]) | (key[1:] != key[:-1])
        cuts = np.append(np.flatnonzero(new), len(f))
        # buckets of one member are most: they are passed over, but for those that the batch begins or ends with
        sizes = np.diff(cuts)
        some = np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1))
        done = []
        for lo, n in zip(cuts[some].tolist(), sizes[some].tolist(), strict=True):
            if (way[lo], key[lo]) != current:
                if held and size > 1:
                    done.append(_hanging_together(np.concatenate(held), radius))
                held, size, current = [], 0, (way[lo], key[lo])
            held.append(f[lo : lo + n].copy())
            size += n
            if size > bucket:
                yield over(np.concatenate(held), int(way[lo]), int(fixed[lo]))
                held = []
        yield linked(done)
    if held and size > 1:
        yield linked([_hanging_together(np.concatenate(held), radius)])


def _pairs(done: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *(x[0] for x in done)]), np.concatenate([none, *(x[1] for x in done)])


def _hanging_together(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest, other) of each group that links within `radius` bits hold together, found breadth first."""
    rest, out = np.unique(fp), []
    while len(rest) > 1:
        first, front, rest = rest[0], [rest[0]], rest[1:]
        while front and len(rest):
            near = np.bitwise_count(rest ^ front.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                front += found.tolist()
                out.append((np.full(len(found), first), found))
    return _pairs(out)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps, each one shuffle, until no pair changes; the number of rounds grows
    with the logarithm of the nodes. Pairs are written to shared storage after each round, only counts reach the driver.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs, before = stored(edges, "pairs"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # written first, so that a node of very many edges is a skewed join, whose partitions Spark splits
        least = stored(both.groupBy("hi").agg(F.min("lo").alias("m")).withColumn("m", F.least("m", "hi")), "least")
        large = both.join(least, "hi").filter(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        large = stored(large, "large")
        small_least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(small_least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p")).select("p.hi", "p.lo").filter("hi != lo").distinct()
        old, pairs = pairs, stored(small, "pairs")
        discard(old, least, large, small_least)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id that links of at most `radius` bits reach.

    Equal fingerprints are one node, so copies are never paired. Rows with a null id are linked like others and
    take part in components, but never name one unless all ids of it are null. An empty table gives an empty result;
    repeated rows repeat their result; columns besides id and text are left out, whatever their names.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = stored(components(links(nodes.select("fp"), radius)), "roots")
    # every step is written, so that joins are of plain tables: Spark splits their hot keys
    linked = stored(nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least"), "linked")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("component")), "least")
    linked = linked.join(least, "root").select("fp", "component")
    named = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "named")
    return rows.join(named, "fp").select("id", "fp", "component")


def hex64(col) -> F.Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))

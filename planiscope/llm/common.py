"""What the text operators share: shared storage, row identity, and words and hashes as arrays."""

from __future__ import annotations

import functools
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Word separators of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    tidy(spark)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `stored` wrote, once nothing that is still to be computed reads it."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession, now: bool = False) -> None:
    """A collection, after which Spark drops shuffle files and broadcasts of finished steps: `now`, or once half of the
    driver's heap is in use."""
    run = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if now or 2 * (run.totalMemory() - run.freeMemory()) > run.maxMemory():
        for _ in range(1 + now):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            if now:  # what has just ended is still on its way to the listeners, and so held
                time.sleep(0.5)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, as the count for explicit repartitioning."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, *taken: list[str]) -> str:
    """A column name like `name` that is not taken, whatever the case."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, ties: list[F.Column] | None = None) -> tuple[DataFrame, str]:
    """`docs` with a column that tells its rows apart, and that column's name; without `keep`, id and text only.

    The numbers order rows as (id, hash of the text or else `ties`), null ids first. Where ids are unique and not null, which a scan
    of the id column alone shows, the id is the number and nothing moves. Else rows are dealt by range, rows that are
    alike by their places in the input too, and stored once.
    """
    uid = fresh("uid", docs.columns)
    rows = docs if keep else docs.select(F.col(id_col), F.col(text_col))
    key = F.col(id_col).cast("long")
    seen = docs.select(key.alias("id")).groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.max(F.col("id").isNull()).alias("nulls")).first()
    if seen["most"] in (None, 1) and not seen["nulls"]:
        return rows.withColumn(uid, key), uid
    place = fresh("place", docs.columns, [uid])
    order = [key.asc_nulls_first(), *(ties or [F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]), F.col(place)]
    ranged = rows.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    return stored(ranged.drop(place).withColumn(uid, F.monotonically_increasing_id()), "numbered"), uid


def with_uid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, text): a row for every row of `docs`, with a unique uid (see numbered); null texts are empty."""
    rows, uid = numbered(docs, id_col, text_col, keep=False)
    return rows.select(F.col(uid).alias("uid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First uids of the shards after the first, for (uid, size) with unique uids: bytes are counted along the order of
    uids, and a shard begins at each full `shard_bytes`. So bounds depend on the data alone. The driver gets a number for
    every partition and for every shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            after = done + np.cumsum(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            if len(after):
                before = np.append(done, after[:-1])
                done = int(after[-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(after), part, np.int32)), b.column(0), pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=["part", "uid", "before", "after"])

    ranged = sizes.repartitionByRange(partitions(sizes), "uid").sortWithinPartitions("uid")
    placed = stored(ranged.select("uid", "size").mapInArrow(run, "part int, uid long, before long, after long"), "placed")
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.max("after").alias("n")).collect())
    if not totals:
        return []
    starts = np.cumsum([0] + [n for _, n in totals])[:-1].tolist()
    offsets = sizes.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(totals, starts, strict=True)], "part int, start long")
    shard = F.floor((F.col("before") + F.col("start")) / shard_bytes)
    rows = placed.join(offsets, "part").groupBy(shard.alias("shard")).agg(F.min("uid").alias("uid")).collect()
    discard(placed)
    return sorted(r["uid"] for r in rows)[1:]


def by_shard(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """`rows` (uid and others) with their shard's number, each shard one partition, in the order of uids."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    @F.arrow_udf("int")
    def shard(uid: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sent.value, uid.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    return rows.withColumn("shard", shard("uid")).repartitionById(len(bounds) + 1, F.col("shard"))


def commit_file(fs: pafs.FileSystem, temp: str, name: str) -> None:
    """Rename a whole file to its name; what an earlier attempt of the same task left there has the same bytes and goes."""
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        fs.delete_file(name)
    fs.move(temp, name)


# --------------------------------------------------------------------------- arrays


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes of text: first row, row after the last, bytes, byte offsets from 0."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words of concatenated documents."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_IS_SPACE[buf]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offs[:-1][np.diff(offs) > 0]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = first[1:] - 1
    end[last] = inside[last]
    ends = np.flatnonzero(end)
    return starts, ends + 1, np.searchsorted(offs, starts, side="right") - 1


@functools.lru_cache(None)
def _hash_tables(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(0x5EED0000 + seed)
    return rng.integers(0, 1 << 64, 256, dtype=np.uint64), int(rng.integers(1 << 62, 1 << 63)) * 2 + 1


@functools.lru_cache(2)
def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    p = _hash_tables(seed)[1]
    out = []
    for base in (p, pow(p, -1, 1 << 64)):
        a = np.full(size, base, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    room = 1 << 19
    while room < size + 1:
        room *= 2
    return _powers(seed, room)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buf: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums of a polynomial hash of bytes modulo 2**64; see span_hash."""
    table, _ = _hash_tables(seed)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers(seed, len(buf))[0][: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte spans, equal wherever the bytes are equal."""
    inverse = powers(seed, len(prefix))[1]
    return mixed((prefix[ends] - prefix[starts]) * inverse[starts] + np.uint64(0x9E3779B97F4A7C15) * (ends - starts).astype(np.uint64))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a concatenation from the hashes of its two parts, in order."""
    return mixed(a * np.uint64(0xFF51AFD7ED558CCD) + (b ^ np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC4CEB9FE1A85EC53))


def window_hash(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of `length` tokens by doubling: 1, 2, 4, ... and last two overlapping powers of two."""
    size = len(tokens) - length + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    x, k = tokens, 1
    while k * 2 <= length:
        x = joined_hash(x[: len(x) - k], x[k:])
        k *= 2
    if k < length:
        x = joined_hash(x[:size], x[length - k : length - k + size])
    return x


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` consecutive values the index of its smallest, the leftmost on ties."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # (value, index) packed: the top 40 bits order, the low 24 bits hold the place within the array's block
    order = x >> np.uint64(24)
    out = np.empty(n, np.int64)
    step = (1 << 24) - width
    for at in range(0, n, step):
        part = order[at : at + step + width - 1]
        key = (part << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        pad = -len(key) % width
        blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - width + 1
        best = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
        out[at : at + m] = (best & np.uint64(0xFFFFFF)).astype(np.int64) + at
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated integer ranges start, start + 1, ... of the given sizes."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]

"""Token-id output: documents packed into fixed-length rows by best-fit decreasing.

Documents longer than a row are cut into whole rows and one rest, so that nothing is lost; pieces of a packing window are
placed longest first, each into the row with the least room that still holds it. A segment tree over the possible
amounts of room finds that row in logarithmic time, whatever the number of open rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import load_ranks
from .common import by_shard, commit_file, shard_bounds, shared_dir, stored, with_uid

#: Tokens of a packed row, and bytes of text in one packing window, which one task holds in memory as ids.
ROW = 2048
WINDOW = 1 << 23

SCHEMA = "pack_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<int>"
_ARROW = pa.schema(
    [("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int32()))]
)


class RoomTree:
    """Open rows by their room, over a segment tree whose nodes tell whether any row lies below."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least `size`, the one put last on ties, and its room."""
        at = size + self.leaves
        if at >= 2 * self.leaves:
            return None
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.any[at] = 0
            at //= 2
            while at and not (self.any[2 * at] or self.any[2 * at + 1]):
                self.any[at] = 0
                at //= 2
        return row, room


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Rows as lists of piece numbers; pieces of equal size keep their order."""
    tree, rows = RoomTree(row), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, row
        at, room = found
        rows[at].append(i)
        if room > sizes[i]:
            tree.put(at, room - sizes[i])
    return rows


@functools.lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def _packs(pieces: list[tuple[int | None, int, np.ndarray]], row: int, pad: int, dtype: str, first: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing([len(p[2]) for p in pieces], row)
    for lo in range(0, len(rows), 256):
        cols: list[list] = [[] for _ in _ARROW.names]
        for k, members in enumerate(rows[lo : lo + 256], lo):
            own = [pieces[i] for i in members]
            cu = np.concatenate([[0], np.cumsum([len(p[2]) for p in own])]).astype(np.int32)
            line = np.full(row, pad, dtype)
            line[: cu[-1]] = np.concatenate([p[2] for p in own])
            for c, v in zip(cols, (first + k, int(cu[-1]), len(own), line.tobytes(), cu, cu[:-1], [p[0] for p in own], [p[1] for p in own]), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW.types, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, path: str, pattern: str, row: int = ROW, pad: int = 0, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Packed rows of all documents' token ids.

    ids: `row` little-endian unsigned ids (16 bits if the vocabulary allows, else 32), padded with `pad`; cu_seqlens:
    where segments begin and end; position_resets: where positions start again from 0; doc_ids and doc_offsets: each
    segment's document and its first token's place there, so texts of any length can be put together again. `end_id`
    is appended to every document. Null and empty texts have no tokens and, without end_id, no segment. Repeated rows
    are packed each, ids may be null or repeat. Empty tables give no rows; other columns are left out. Windows are
    stretches of some `window` bytes and one text more at most in the order of ids (see common.shard_bounds), so the
    packing depends on the data alone, not on its files; pack_id holds the window and the row's number in it.
    """
    size = max(load_ranks(path).values()) + 1
    dtype = "<u2" if max(size, pad + 1, (end_id or 0) + 1) <= 1 << 16 else "<u4"
    docs = with_uid(docs, id_col, text_col)
    bounds = shard_bounds(docs.select("uid", F.octet_length("text").cast("long").alias("size")), window)
    dealt = by_shard(docs.select("uid", "id", "text"), bounds).sortWithinPartitions("uid")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first, pieces = _encoding(path, pattern), 0, []
        for batch in batches:
            if batch.num_rows:
                first = batch.column(2)[0].as_py() << 33
            for at in range(0, batch.num_rows, 256):
                for doc, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    ids = np.array(enc.encode_ordinary(text), dtype)
                    if end_id is not None:
                        ids = np.append(ids, np.array([end_id], dtype))
                    for a in range(0, len(ids), row):
                        pieces.append((doc, a, ids[a : a + row]))
        yield from _packs(pieces, row, pad, dtype, first)

    return dealt.select("id", "text", "shard").mapInArrow(rows, SCHEMA)


def positions(cu_seqlens: list[int], row: int = ROW) -> np.ndarray:
    """Position ids of one packed row: from 0 again at every segment, 0 on the padding."""
    out = np.zeros(row, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out


_META = ("pack_id", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets")


def write(packed: DataFrame, folder: str) -> DataFrame:
    """Write each window's id matrix (<name>.ids, rows one after the other) and its rows' segments (<name>.json).

    `packed` is what `pack` gives: a partition is a window, and names follow its number. Files get temporary names and are
    renamed when whole, the matrix last; the manifest names the valid files and is committed after all of them. A task that
    runs again writes the same bytes to the same names. Returns the manifest (name, rows, bytes, sha256).
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, local = pafs.FileSystem.from_uri(folder)
        name, ids, meta = None, None, None
        count, size, digest = 0, 0, hashlib.sha256()
        for b in batches:
            for r in b.to_pylist():
                if name is None:
                    name = f"packed-{r['pack_id'] >> 33:07d}"
                    temp = f"{local}/_temporary-{name}-{uuid.uuid4().hex}"
                    ids, meta = own.open_output_stream(temp + ".ids"), own.open_output_stream(temp + ".json")
                ids.write(r["ids"])
                digest.update(r["ids"])
                size, count = size + len(r["ids"]), count + 1
                meta.write((json.dumps({k: r[k] for k in _META}) + "\n").encode())
        if name is not None:
            for file, end in ((meta, ".json"), (ids, ".ids")):
                file.close()
                commit_file(own, temp + end, f"{local}/{name}{end}")
            yield pa.RecordBatch.from_pylist([{"name": name, "rows": count, "bytes": size, "sha256": digest.hexdigest()}])

    manifest = stored(packed.mapInArrow(rows, "name string, rows long, bytes long, sha256 string"), "manifest")
    temp = f"{root}/_temporary-manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        for r in manifest.orderBy("name").toLocalIterator():
            f.write((json.dumps(r.asDict()) + "\n").encode())
    commit_file(fs, temp, f"{root}/MANIFEST.jsonl")
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The packed rows (as `pack` gives them) of the files that the manifest names, their sizes and digests checked."""
    names = spark.read.schema("name string, rows long, bytes long, sha256 string").json(f"{folder}/MANIFEST.jsonl")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    for end in ("ids", "json"):
        one = files.filter(F.col("file").endswith(f".{end}")).select(F.regexp_replace("file", rf"\.{end}$", "").alias("name"), F.col("content").alias(end))
        names = names.join(one, "name", "left")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, count, sha256, ids, meta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids is None or meta is None or hashlib.sha256(ids).hexdigest() != sha256:
                    raise ValueError(f"{name} is not what the manifest says")
                lines = meta.splitlines()
                if len(lines) != count:
                    raise ValueError(f"{name} has not {count} rows")
                width = len(ids) // count
                for lo in range(0, count, 256):
                    own = [json.loads(x) for x in lines[lo : lo + 256]]
                    cols = {k: [r[k] for r in own] for k in _META} | {"n_segments": [len(r["doc_ids"]) for r in own], "ids": [ids[k * width : (k + 1) * width] for k in range(lo, lo + len(own))]}
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _ARROW], schema=_ARROW)

    return names.select("name", "rows", "sha256", "ids", "json").mapInArrow(rows, SCHEMA)


def archive(packed: DataFrame, folder: str | None = None) -> DataFrame:
    """Write packed rows to a new folder in the shared one, or to `folder`, and read them back."""
    folder = folder or f"{shared_dir(packed.sparkSession)}/packed-{uuid.uuid4().hex}"
    write(packed, folder)
    return read(packed.sparkSession, folder)

"""Exact duplicate byte strings by a distributed sparse suffix array.

The suffixes that begin at the anchors of windows (see `repeats`: one for some 35 bytes, chosen by content alone, so
that equal strings are sampled at equal places) enter the array, with the bytes before them that their windows reach.
Anchors that occur once in the corpus are left out; that is all that hashes decide. Suffixes are dealt out by range of
their own leading bytes (Spark's range partitioner samples the splitters). Each bucket is read in that order in bounded parts,
which a multikey quicksort sorts, eight bytes to a key: equal neighbours are repeats. Parts and buckets may end amid
suffixes with one beginning; what is not flagged of these is compared across the edges by 128-bit digests of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import discard, partitions, prefix_hash, ranges, span_hash, stored, text_slices, tidy, with_uid

#: Leading bytes of an anchored suffix: the anchor.
LEAD = 32
#: Suffixes that are sorted at a time.
CHUNK = 8192


# --------------------------------------------------------------------------- filter


_SPAN = (("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("back", pa.int32()))


def _anchored(batches: Iterator[pa.RecordBatch], length: int, lead: int) -> Iterator[tuple[list, list, np.ndarray]]:
    """Key (anchor), rest (uid, first window, windows, bytes from it to the anchor) and weight of every span."""
    for batch in batches:
        uids = batch.column(0).to_numpy()
        for lo, buf, offs, base, _ in repeats.slices(batch, False, length):
            if len(buf) < length:
                continue
            doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
            at = np.arange(len(buf) - lead + 1)
            runs = span_hash(prefix_hash(buf, 0), at, at + lead, 0)
            a, m, t = repeats.anchors(runs, doc, length, lead)
            d = doc[a]
            yield [runs[t].view(np.int64)], [uids[lo + d], a - offs[d] + base, m, t - a], np.full(len(a), repeats.OPEN, np.int8)


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of spans; of those with equal bytes in a batch the first by (uid, start) goes on, the others are flagged."""
    names = ["uid", "start", "n", "back", "piece"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    for batch in batches:
        uids = batch.column(batch.schema.get_field_index("uid")).to_pylist()
        texts = batch.column(batch.schema.get_field_index("text"))
        lists = repeats.row_lists(batch.column(batch.schema.get_field_index("spans")))
        best: dict[tuple[bytes, int], tuple[int, int, int]] = {}
        out: list[tuple] = []
        size = 0
        for i, (starts, counts, backs) in enumerate(lists):
            text, uid = texts[i].as_buffer(), uids[i]
            data = memoryview(text)
            for a, m, b in zip(starts.tolist(), counts.tolist(), backs.tolist(), strict=True):
                key = (bytes(data[a : a + m - 1 + length]), b)
                here = (uid, a, m)
                other = best.setdefault(key, here)
                if other is not here:
                    if here < other:
                        best[key], here = here, other
                    out.append((*here, b, None))
                else:
                    size += len(key[0])
            if size > 1 << 21 or len(out) > 1 << 16:
                yield _batch(out + [(*v, b, piece) for (piece, b), v in best.items()], names, types)
                best, out, size = {}, [], 0
        yield _batch(out + [(*v, b, piece) for (piece, b), v in best.items()], names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


# --------------------------------------------------------------------------- buckets


def multikey_sort(first: np.ndarray, depth: int, char: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey quicksort of strings of `first` and `depth` further characters: their order, and the segments (begin,
    size) of it that hold two or more equal strings.

    char(d, items) gives further character d of items. All segments are parted at once, each by the character of its
    middle item into less, equal and greater; equal parts go on with the next character, and parts of one item end.
    """
    order = np.argsort(first, kind="stable")
    edge = np.flatnonzero(np.append(True, first[order[1:]] != first[order[:-1]])) if len(first) else np.zeros(0, np.int64)
    lo, size = _large(edge, np.diff(np.append(edge, len(first))))
    for d in range(depth):
        if not len(lo):
            break
        items = order[ranges(lo, size)]
        key = char(d, items)
        equal: list[tuple[np.ndarray, np.ndarray]] = []
        while len(lo):
            begin = np.cumsum(size) - size
            pivot = np.repeat(key[begin + size // 2], size)
            same = key == pivot
            count = np.add.reduceat(same, begin, dtype=np.int64)
            if (count == size).all():
                equal.append((lo, size))
                break
            less = key < pivot
            fewer = np.add.reduceat(less, begin, dtype=np.int64)
            rank = lambda mine, counts: np.cumsum(mine) - 1 - np.repeat(np.cumsum(counts) - counts, size)  # noqa: B023, E731
            start = np.repeat(begin, size)
            place = start + np.where(less, rank(less, fewer), np.where(same, np.repeat(fewer, size) + rank(same, count), np.repeat(fewer + count, size) + rank(~(less | same), size - fewer - count)))
            items[place], key[place] = items.copy(), key.copy()
            order[ranges(lo, size)] = items
            equal.append(_large(lo + fewer, count))
            parts = np.concatenate([lo, lo + fewer + count]), np.concatenate([fewer, size - fewer - count])
            near = np.concatenate([begin, begin + fewer + count])
            keep = parts[1] > 1
            lo, size, near = parts[0][keep], parts[1][keep], near[keep]
            at = ranges(near, size)
            items, key = items[at], key[at]
        lo, size = (np.concatenate(x) for x in zip(*equal, strict=True))
    return order, lo, size


def _large(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = size > 1
    return lo[keep], size[keep]


def _later(first: np.ndarray, depth: int, char: Callable[[int, np.ndarray], np.ndarray], uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which items equal one that comes before them by (uid, start): equal neighbours of the sorted order."""
    order, lo, size = multikey_sort(first, depth, char)
    items, group = order[ranges(lo, size)], np.repeat(np.arange(len(lo)), size)
    items = items[np.lexsort((start[items], uid[items], group))]
    out = np.zeros(len(first), bool)
    out[items] = True
    out[items[np.cumsum(size) - size]] = False
    return out


_FOUND = "uid long, start int, stop int, h1 long, h2 long"
_FOUND_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _compare(batches: Iterator[pa.RecordBatch], length: int, lead: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Flagged runs of a bucket in the order of its suffixes, and digests of windows that may repeat beyond an edge."""
    held: pa.Table | None = None
    before = None  # beginning of the suffix before those held; at first it is not known what the bucket before ends with
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
        while held.num_rows > chunk:
            heads = held.column("head").slice(0, chunk + 1).to_pylist()
            cut = chunk
            while cut and heads[cut - 1] == heads[chunk]:
                cut -= 1
            cut = cut or chunk  # one beginning fills the part: it ends amid it
            yield from _compare_part(held.slice(0, cut), before, heads[cut], length, lead)
            before = heads[cut - 1]
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield from _compare_part(held, before, None, length, lead)


def _compare_part(t: pa.Table, before: bytes | None, after: bytes | None, length: int, lead: int) -> Iterator[pa.RecordBatch]:
    """One part; a neighbouring beginning that is None is that of another bucket and may be equal."""
    t = t.combine_chunks()
    heads = t.column("head").to_pylist()
    uid, start, n, back = (t.column(c).to_numpy().astype(np.int64) for c in ("uid", "start", "n", "back"))
    piece = t.column("piece").chunk(0)
    (((_, _, buf, offs)),) = list(text_slices(pa.RecordBatch.from_arrays([piece], names=["piece"]), "piece", 1 << 62))
    new = np.array([True] + [x != y for x, y in zip(heads[1:], heads[:-1], strict=True)])
    head = np.cumsum(new) - 1
    open_ends = np.zeros(head[-1] + 1, bool)
    open_ends[0] |= before is None or before == heads[0]
    open_ends[-1] |= after is None or after == heads[-1]
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)
    eight = np.ascontiguousarray(eight).view(">u8").ravel().astype(np.uint64)
    size, base = np.diff(offs), offs[:-1]
    shape = (head << 24 | back << 12 | n).astype(np.uint64)

    def whole(d: int, i: np.ndarray) -> np.ndarray:  # the bytes of the span
        left = size[i] - 8 * d
        key = eight[np.minimum(base[i] + 8 * d, len(eight) - 1)]
        return np.where(left > 0, key >> (np.uint64(64) - 8 * np.clip(left, 1, 8).astype(np.uint64)), np.uint64(0))

    later = _later(shape, -(-int(size.max()) // 8), whole, uid, start)
    yield _runs(np.repeat(uid[later], n[later]), ranges(start[later], n[later]), length)
    # one span of each content is left: its windows, as suffixes with equal beginnings and equal distances to them
    row = np.repeat(np.flatnonzero(~later), n[~later])
    within = ranges(np.zeros(int((~later).sum()), np.int64), n[~later])
    at, place = base[row] + within, (head[row] << 12 | (back[row] - within)).astype(np.uint64)

    def window(d: int, i: np.ndarray) -> np.ndarray:
        return eight[at[i] + 8 * d] >> np.uint64(64 - 8 * min(8, length - 8 * d))

    again = _later(place, -(-length // 8), window, uid[row], start[row] + within)
    yield _runs(uid[row[again]], start[row[again]] + within[again], length)
    ask = np.flatnonzero(~again & open_ends[head[row]])
    if len(ask):
        digests = [span_hash(prefix_hash(buf, s), at[ask], at[ask] + length, s).view(np.int64) for s in (2, 3)]
        where = start[row[ask]] + within[ask]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([uid[row[ask]], where, where + length, *digests], _FOUND_TYPES, strict=True)], names=["uid", "start", "stop", "h1", "h2"])


def _runs(uid: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(uid)) - 1 if len(uid) else first
    none = pa.nulls(len(first), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(uid[first], pa.int64()), pa.array(at[first], pa.int32()), pa.array(at[last] + length, pa.int32()), none, none], names=["uid", "start", "stop", "h1", "h2"])


def repeated_spans(docs: DataFrame, length: int, chunk: int = CHUNK) -> DataFrame:
    """(uid, start, stop): byte ranges of `docs` (uid, text) covered by strings of `length` bytes that begin earlier too."""
    lead = min(LEAD, max(1, length // 2))
    step = repeats.Level(("key",), _SPAN)
    rows = step.deal(docs.select("uid", "text").mapInArrow(lambda it: step.combined(_anchored(it, length, lead)), step.ddl))

    def survivors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in step.settled(it):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(r, _SPAN, strict=True)], names=[x for x, _ in _SPAN])

    spans = stored(rows.mapInArrow(survivors, "uid long, start int, n int, back int"), "spans")
    del rows
    tidy(docs.sparkSession, now=True)  # the levels' shuffle files go before the texts move
    texts = repeats.with_lists(docs.select("uid", "text"), spans, "start", "n", "back", how="inner")
    pieces = stored(texts.mapInArrow(lambda it: _pieces(it, length), "uid long, start int, n int, back int, piece binary"), "pieces")
    tidy(docs.sparkSession, now=True)
    head = F.col("piece").substr(F.col("back") + 1, F.lit(lead)).alias("head")
    suffix = F.col("piece").substr(F.col("back") + 1, F.lit(length))
    open_pieces = pieces.filter("piece is not null")
    # suffixes with one beginning may go to several buckets: by what follows it, by what is before it, by document
    buckets = open_pieces.repartitionByRange(partitions(docs), suffix, "piece", "uid", "start").select("uid", "start", "n", "back", "piece", head).sortWithinPartitions("head")
    found = stored(buckets.mapInArrow(lambda it: _compare(it, length, lead, chunk), _FOUND), "found")
    whole = pieces.filter("piece is null").select("uid", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))
    asked = found.filter("h1 is not null")
    least = F.struct("uid", "start")
    several = asked.groupBy("h1", "h2").agg(F.min(least).alias("least"), F.count("*").alias("c")).filter("c > 1")
    across = asked.join(several, ["h1", "h2"]).filter(least != F.col("least")).select("uid", "start", "stop")
    out = stored(whole.unionByName(found.filter("h1 is null").select("uid", "start", "stop")).unionByName(across), "ranges")
    discard(spans, pieces, found)
    return out


# --------------------------------------------------------------------------- operator


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("id"))
        spans = repeats.row_spans(batch.column(batch.schema.get_field_index("spans")))
        for lo, hi, buf, offs in text_slices(batch, "text", 1 << 20):
            size, removed, runs, digest, kept = [], [], [], [], []
            for i in range(lo, hi):
                s, e = next(spans)
                own = buf[offs[i - lo] : offs[i - lo + 1]]
                if len(s):
                    mask = np.ones(len(own), bool)
                    mask[ranges(s, e - s)] = False
                    rest = own[mask].tobytes()
                else:
                    rest = own.tobytes()
                size.append(len(own))
                removed.append(len(own) - len(rest))
                runs.append(len(s))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest)
            cols = [ids.slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if with_text else []), names=names)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row after removal of repeated byte strings.

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or before
    it in the same one. Overlaps count and strings are judged on the input. Matches never cross documents. Null texts
    are empty, null ids come first. Rows that share an id are documents in the order of their texts' hashes, then of the
    input, so of rows that are alike the first keeps its text. An empty table gives an empty result. Other columns are
    left out. `kept` holds bytes, as a cut may fall inside a character.
    """
    rows = with_uid(docs, id_col, text_col)
    found = repeats.with_lists(rows, repeated_spans(rows, length, chunk), "start", "stop")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return found.select("id", "text", "spans").mapInArrow(lambda it: _kept(it, with_text), schema)

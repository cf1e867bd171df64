"""What both duplicate-substring operators share: anchors of windows, and which keys occur more than once.

A window is `length` tokens (bytes or words) of one document. Its anchor is the run of `lead` tokens in it whose hash
is least. Equal windows have equal anchors at equal places, and windows in a row that share an anchor form one span;
there are some 2 / (length - lead + 2) spans per token. An anchor that occurs once shows that no window of its span repeats.

`Level` says which rows have a key that others have too. A task first combines the rows it reads: keys that it sees
twice are settled there and send one mark on, so one key gives a row per task and flush at most, however common it is. What
is left meets by key in sorted order and is settled as a stream, in memory that does not depend on the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_SPACE, merged, mixed, partitions, sliding_argmin, text_slices, word_bounds

#: Bytes of text that are worked on at a time, and rows that are combined at a time.
SLICE = 1 << 17
FLUSH = 1 << 18

#: A row that adds nothing to its key's count, one that counts, a mark for a key that occurs twice, and a settled row.
EXTRA, OPEN, MARK, HIT = range(4)


def slices(batch: pa.RecordBatch, words: bool, length: int, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """Parts of a batch with some `limit` bytes: first row, bytes, byte offsets, and for a part of one long text the
    number of its first token and of its tokens. Long texts are cut so that every window lies in one part whole, and
    begins in one only."""
    for lo, hi, buf, offs in text_slices(batch, "text", limit):
        if hi - lo > 1 or len(buf) <= 2 * limit:
            yield lo, buf, offs, 0, len(buf)
        elif not words:
            for at in range(0, max(1, len(buf) - length + 1), limit):
                part = buf[at : at + limit + length - 1]
                yield lo, part, np.array([0, len(part)]), at, len(part)
        else:
            at = base = 0
            while at < len(buf):
                end = _space(buf, at + limit)
                stop, more = end, 0
                while stop < len(buf) and more < length - 1:
                    stop = _space(buf, stop + 8 * length)
                    more = len(word_bounds(buf[end:stop], np.array([0, stop - end]))[0])
                part = buf[at:stop]
                here = len(word_bounds(buf[at:end], np.array([0, end - at]))[0])
                yield lo, part, np.array([0, len(part)]), base, here + length - 1
                at, base = end, base + here


def _space(buf: np.ndarray, at: int) -> int:
    """Place of the first white space from `at` on, or the end."""
    while at < len(buf):
        found = np.flatnonzero(_IS_SPACE[buf[at : at + 4096]])
        if len(found):
            return at + int(found[0])
        at += 4096
    return len(buf)


def anchors(lead: np.ndarray, doc: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every span, from the hashes of all runs of `size` tokens."""
    best = sliding_argmin(lead, length - size + 1)
    ok = doc[: len(best)] == doc[length - 1 :]
    new, stop = ok.copy(), ok.copy()
    new[1:] &= (best[1:] != best[:-1]) | ~ok[:-1]
    stop[:-1] &= new[1:] | ~ok[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    return first, last - first + 1, best[first]


@dataclass(frozen=True)
class Level:
    """Rows with `keys` (long) and `rest` (name to Arrow type), of which those whose keys repeat are wanted."""

    keys: tuple[str, ...]
    rest: tuple[tuple[str, pa.DataType], ...]

    @property
    def arrow(self) -> pa.Schema:
        return pa.schema([*((k, pa.int64()) for k in self.keys), *self.rest, ("tag", pa.int8())])

    @property
    def ddl(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in from_arrow_schema(self.arrow))

    def combined(self, parts: Iterable[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Rows (keys, rest, tag) as they are dealt out."""
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part[2])
            if size >= FLUSH:
                yield from self._combine(held)
                held, size = [], 0
        if size:
            yield from self._combine(held)

    def _combine(self, held: list) -> Iterator[pa.RecordBatch]:
        keys = [np.concatenate([p[0][i] for p in held]) for i in range(len(self.keys))]
        rest = [np.concatenate([p[1][i] for p in held]) for i in range(len(self.rest))]
        tag = np.concatenate([p[2] for p in held]).astype(np.int8)
        new, group, order = _groups(keys)
        keys, rest, tag = [k[order] for k in keys], [r[order] for r in rest], tag[order]
        many = np.bincount(group, tag)[group] >= 2
        marks, left, hit = np.flatnonzero(new & many), np.flatnonzero(~many), np.flatnonzero(many)
        # settled rows need no key: they stay together by document, which packs well, wherever that goes
        hit = hit[np.lexsort((rest[1][hit], rest[0][hit]))]
        away = mixed(rest[0][hit].astype(np.int64).view(np.uint64)).view(np.int64)
        zeros = [np.zeros(len(hit), np.int64)] * (len(keys) - 1)
        parts = [([away, *zeros], hit, np.full(len(hit), HIT, np.int8)), ([k[left] for k in keys], left, tag[left]), ([k[marks] for k in keys], marks, np.full(len(marks), MARK, np.int8))]
        for own, rows, tags in parts:
            for at in range(0, len(rows), 1 << 16):
                cut = slice(at, at + (1 << 16))
                yield self._batch([*(k[cut] for k in own), *(r[rows[cut]] for r in rest), tags[cut]])

    def _batch(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)

    def deal(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(rows), self.keys[0]).sortWithinPartitions(*self.keys)

    def settled(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """The rest of every row whose keys occur twice or more, from a partition sorted by keys."""
        n, carry = len(self.keys), None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            hit = cols[-1] == HIT
            if hit.any():
                yield [c[hit] for c in cols[n:-1]]
                cols = [c[~hit] for c in cols]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            tag = cols[-1]
            new = _changes(cols[:n])
            group = np.cumsum(new) - 1
            many = np.bincount(group, tag) >= 2
            pick = many[group] & (tag < MARK)
            yield [c[pick] for c in cols[n:-1]]
            last = int(np.flatnonzero(new)[-1])
            if many[-1]:  # what follows of this key repeats
                carry = [c[last : last + 1].copy() for c in cols]
                carry[-1][:] = MARK
            else:
                carry = [c[last:].copy() for c in cols]


def _changes(keys: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = _changes([k[order] for k in keys])
    return new, np.cumsum(new) - 1, order


def with_lists(docs: DataFrame, rows: DataFrame, *columns: str, how: str = "left") -> DataFrame:
    """`docs` with `spans`, the list of each document's `rows` (no longer than the document itself), null where there are none."""
    lists = rows.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias("spans"))
    return docs.join(lists, "uid", how)


def row_lists(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The fields of each row's list."""
    bounds = column.offsets.to_numpy()
    fields = [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in column.flatten().flatten()]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        lo, hi = (bounds[i] - bounds[0], bounds[i + 1] - bounds[0]) if valid[i] else (0, 0)
        yield [f[lo:hi] for f in fields]


def row_spans(column: pa.Array, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Maximal runs of each row's (start, stop), or of the windows of `length` that begin at its (start)."""
    for row in row_lists(column):
        yield merged(row[0], row[0] + length if length else row[1])

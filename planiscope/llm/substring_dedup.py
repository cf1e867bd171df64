"""Removal of word windows that occur more than once, by level-wise doubling.

The lengths are halves of halves of the window's, rounded up: 9, 18 and 35 words. Short windows come first: one of nine
words per window of the full length (its anchor, see `repeats`), which is enough to miss none. Only those that another
place of the corpus has too are extended to eighteen words around the anchor, only repeats of eighteen to thirty-five; a
window that stands alone at any level is dropped there. Every level is settled over the whole corpus before the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import discard, joined_hash, prefix_hash, ranges, span_hash, stored, text_slices, tidy, window_hash, with_uid, word_bounds

#: Lengths are halved until they are no longer than this.
LEAST = 10


def levels(length: int) -> list[int]:
    out = [length]
    while len(out) < 2 or out[0] > LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def _anchored(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[tuple[list, list, np.ndarray]]:
    """Keys (anchor), rest (uid, first window, windows, block hashes of the middle levels) and weight of every span.

    A block of l words lies around the anchor at t as [t - (l - lead), t + lead) where the window begins early enough,
    else as [t, t + l); spans are cut in two where that changes, and only the first part counts for the anchor.
    """
    lead, middle, length = sizes[0], sizes[1:-1], sizes[-1]
    for batch in batches:
        uids = batch.column(0).to_numpy()
        for lo, buf, offs, base, most in repeats.slices(batch, True, length):
            starts, ends, doc = (x[:most] for x in word_bounds(buf, offs))
            if len(starts) < length:
                continue
            words = span_hash(prefix_hash(buf, 0), starts, ends, 0)
            runs = window_hash(words, lead)
            a, m, t = repeats.anchors(runs, doc, length, lead)
            if not len(a):
                continue
            tag = np.full(len(a), repeats.OPEN, np.int8)
            for size in middle:  # the first windows of a span up to t - (size - lead), then the others
                early = np.clip(t - (size - lead) - a + 1, 0, m)
                both = (early > 0) & (early < m)
                cut = np.flatnonzero(both)
                a, m, t, tag = (np.concatenate([x, y]) for x, y in ((np.where(both, a, a), a[cut] + early[cut]), (np.where(both, early, m), (m - early)[cut]), (t, t[cut]), (tag, np.full(len(cut), repeats.EXTRA, np.int8))))
            blocks = [_doubled(runs, sizes, k, np.where(a <= t - (size - lead), t - (size - lead), t)).view(np.int64) for k, size in enumerate(middle, 1)]
            first = np.searchsorted(doc, np.arange(len(offs) - 1))
            d = doc[a]
            yield [runs[t].view(np.int64)], [uids[lo + d], a - first[d] + base, m, *blocks], tag


def _doubled(runs: np.ndarray, sizes: list[int], level: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the runs of sizes[level] words at `at`, each of two overlapping runs of the level below."""
    if not level:
        return runs[at]
    return joined_hash(_doubled(runs, sizes, level - 1, at), _doubled(runs, sizes, level - 1, at + sizes[level] - sizes[level - 1]))


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list, np.ndarray]]:
    """Two hashes of every window of the surviving spans, with its document and place."""
    for batch in batches:
        uids = batch.column(batch.schema.get_field_index("uid")).to_numpy()
        lists = list(repeats.row_lists(batch.column(batch.schema.get_field_index("spans"))))
        for lo, buf, offs, base, most in repeats.slices(batch, True, length):
            starts, ends, doc = (x[:most] for x in word_bounds(buf, offs))
            size = len(starts) - length + 1
            if size <= 0:
                continue
            first = np.searchsorted(doc, np.arange(len(offs) - 1))
            live = np.zeros(size, bool)
            for i in range(len(offs) - 1):
                a, m = lists[lo + i]
                at = ranges(a, m) - base
                live[at[(at >= 0) & (at < size - first[i])] + first[i]] = True
            live &= doc[:size] == doc[length - 1 :]
            at = np.flatnonzero(live)
            keys = [window_hash(span_hash(prefix_hash(buf, s), starts, ends, s), length)[at].view(np.int64) for s in (0, 1)]
            d = doc[at]
            yield keys, [uids[lo + d], at - first[d] + base], np.full(len(at), repeats.OPEN, np.int8)


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(uid, start): the windows of `docs` (uid, text) whose words another place has too.

    Words are told apart by 64-bit hashes while candidates are sought and by 128 bits at the full length.
    """
    sizes = levels(length)
    span = (("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()))
    names = [f"block{i}" for i in range(len(sizes) - 2)]
    steps = [repeats.Level(("key",), span + tuple((x, pa.int64()) for x in names[i:])) for i in range(len(sizes) - 1)]
    rows = docs.select("uid", "text").mapInArrow(lambda it, step=steps[0]: step.combined(_anchored(it, sizes)), steps[0].ddl)
    for now, then in zip(steps, steps[1:], strict=False):  # the next level's key is the first of the blocks

        def extend(it: Iterator[pa.RecordBatch], now=now, then=then) -> Iterator[pa.RecordBatch]:
            return then.combined(([r[3]], r[:3] + r[4:], np.full(len(r[0]), repeats.OPEN, np.int8)) for r in now.settled(it))

        rows = now.deal(rows).mapInArrow(extend, then.ddl)

    def survivors(it: Iterator[pa.RecordBatch], step=steps[-1]) -> Iterator[pa.RecordBatch]:
        for r in step.settled(it):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(r, span, strict=True)], names=["uid", "start", "n"])

    spans = stored(steps[-1].deal(rows).mapInArrow(survivors, "uid long, start int, n int"), "spans")
    del rows
    tidy(docs.sparkSession, now=True)  # the levels' shuffle files go before the texts move
    full = repeats.Level(("h1", "h2"), span[:2])
    texts = repeats.with_lists(docs.select("uid", "text"), spans, "start", "n", how="inner")
    windows = full.deal(texts.mapInArrow(lambda it: full.combined(_windows(it, length)), full.ddl))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in full.settled(it):
            yield pa.RecordBatch.from_arrays([pa.array(r[0]), pa.array(r[1], pa.int32())], names=["uid", "start"])

    out = stored(windows.mapInArrow(places, "uid long, start int"), "windows")
    discard(spans)
    del windows, texts
    tidy(docs.sparkSession, now=True)
    return out


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool, length: int, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    names = [*keep, "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    for batch in batches:
        others = [batch.column(batch.schema.get_field_index(c)) for c in keep]
        spans = repeats.row_spans(batch.column(batch.schema.get_field_index("spans")), length)
        for lo, hi, buf, offs in text_slices(batch, "text", 1 << 20):
            starts, ends, _ = word_bounds(buf, offs)
            base = np.searchsorted(starts, offs)
            data = buf.tobytes()
            words, removed, digest, kept = [], [], [], []
            for i in range(lo, hi):
                s, e = next(spans)
                b0, b1 = base[i - lo], base[i - lo + 1]
                own = data[offs[i - lo] : offs[i - lo + 1]]
                gone = int((e - s).sum())
                if gone:
                    stay = np.ones(b1 - b0, bool)
                    stay[ranges(s, e - s)] = False
                    left = np.flatnonzero(stay) + b0
                    line = b" ".join([data[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                else:
                    line = b" ".join(own.split())
                words.append(int(b1 - b0))
                removed.append(gone)
                digest.append(hashlib.sha256(line).hexdigest())
                if with_text:
                    kept.append(_without(own, starts[b0:b1] - offs[i - lo], ends[b0:b1] - offs[i - lo], s, e) if gone else own.decode())
            cols = [*(x.slice(lo, hi - lo) for x in others), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if with_text else []), names=names)


def _without(text: bytes, starts: np.ndarray, ends: np.ndarray, s: np.ndarray, e: np.ndarray) -> str:
    """The text without its words s to e, and without the space that follows each run."""
    out, at = [], 0
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    out.append(text[at:])
    return b"".join(out).decode()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, with_text: bool = False) -> DataFrame:
    """(uid, id, n_words, n_removed, kept_sha256[, kept]) of every row after removal of repeated word windows.

    A word goes if a window of `length` words that covers it starts anywhere else too; every place of a repeated window
    loses it, the first included. Words are runs without the six ASCII separators and compared unchanged; windows are
    judged on the input and never cross documents. Null and blank texts have no words. Rows that repeat an id, or an id
    and its text, are documents of their own, so a copied row's windows repeat. An empty table gives an empty result.
    Other columns are left out. `kept` is the text without the removed words, its other white space untouched.
    """
    return cleaned(with_uid(docs, id_col, text_col), length, with_text)


def cleaned(rows: DataFrame, length: int = 35, with_text: bool = False, keep: tuple[str, ...] = ("uid", "id")) -> DataFrame:
    """`deduplicate` for `rows` (uid, text and others), told apart by uid, with the columns `keep` of theirs."""
    schema = rows.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    schema = schema.add("kept", "string") if with_text else schema
    found = repeats.with_lists(rows, repeated_windows(rows, length), "start")
    return found.mapInArrow(lambda it: _kept(it, with_text, length, keep), schema)

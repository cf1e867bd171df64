"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regex engine. Code points become classes by one table lookup; each class is a
transition function of a small automaton, the functions and their compositions form a finite monoid, and an
associative scan over its composition table gives the automaton's state after every character at once. Boundaries
follow from neighbouring states. Each slice between boundaries is merged once per worker and then found in a cache.

The pattern served is that of 50k byte-level vocabularies:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of code points.
_SPACE, _WHITE, _LETTER, _NUMBER, _OTHER, _QUOTE, _SDMT, _L, _V, _E, _R = range(11)
_CLASSES = 11
# States: what the text so far ends in.
_START, _IN_LETTERS, _IN_NUMBERS, _IN_OTHERS, _AFTER_SPACE, _AFTER_WHITE, _AT_QUOTE, _QUOTE_L, _QUOTE_V, _QUOTE_R, _SHORT = range(11)
_STATES = 11
_LETTERS = (_LETTER, _SDMT, _L, _V, _E, _R)


def _step(state: int, cls: int) -> int:
    if cls == _SPACE:
        return _AFTER_SPACE
    if cls == _WHITE:
        return _AFTER_WHITE
    if cls == _NUMBER:
        return _IN_NUMBERS
    if cls == _OTHER:
        return _IN_OTHERS
    if cls == _QUOTE:
        return _IN_OTHERS if state in (_IN_OTHERS, _AFTER_SPACE, _AT_QUOTE) else _AT_QUOTE
    if state == _AT_QUOTE:
        return {_SDMT: _SHORT, _L: _QUOTE_L, _V: _QUOTE_V, _R: _QUOTE_R}.get(cls, _IN_LETTERS)
    if (state, cls) in ((_QUOTE_L, _L), (_QUOTE_V, _E), (_QUOTE_R, _E)):
        return _SHORT
    return _IN_LETTERS


@functools.lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Generator of each class, the second half for a document's first character; composition table; functions."""
    gens = [tuple(_step(s, c) for s in range(_STATES)) for c in range(_CLASSES)]
    gens += [tuple([_step(_START, c)] * _STATES) for c in range(_CLASSES)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(_STATES)), *gens]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    if len(known) > 256:
        raise AssertionError("the transition monoid no longer fits a byte")
    funcs = np.array(list(known), np.uint8)
    compose = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    return np.array([known[g] for g in gens], np.uint8), compose, funcs


@functools.lru_cache(1)
def _class_table() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    kinds = {"L": _LETTER, "N": _NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind is not None:
            table[cp] = kind
    table[WHITE_SPACE] = _WHITE
    table[0x20] = _SPACE
    table[ord("'")] = _QUOTE
    for letters, cls in (("sdmt", _SDMT), ("l", _L), ("v", _V), ("e", _E), ("r", _R)):
        table[[ord(x) for x in letters]] = cls
    return table


def _scan(steps: np.ndarray) -> np.ndarray:
    """Inclusive scan of monoid elements under composition: blocks side by side, then the blocks' totals."""
    _, compose, _ = _monoid()
    flat, width = compose.ravel(), compose.shape[1]
    n = len(steps)
    if n <= 512:
        out = np.empty(n, np.uint8)
        acc = 0  # the identity is element 0
        for i, g in enumerate(steps.tolist()):
            acc = int(compose[acc, g])
            out[i] = acc
        return out
    size = max(64, int(n**0.5) // 8)
    blocks = -(-n // size)
    cols = np.zeros((blocks, size), np.uint8)
    cols.ravel()[:n] = steps
    cols = np.ascontiguousarray(cols.T)
    acc = cols[0].astype(np.intp)
    for j in range(1, size):
        acc = flat[acc * width + cols[j]].astype(np.intp)
        cols[j] = acc
    before = np.zeros(blocks, np.intp)
    before[1:] = _scan(cols[-1])[:-1]
    return np.ascontiguousarray(flat[before[None, :] * width + cols].T).ravel()[:n]


def boundaries(text: str, doc_starts: np.ndarray) -> np.ndarray:
    """Indices of the characters that begin a pre-token, of concatenated documents (doc_starts: their first characters)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    cls = _class_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    gens, _, funcs = _monoid()
    state = funcs[_scan(gens[cls + np.uint8(_CLASSES) * first[:n]]), _START]
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = _START, state[:-1]
    prev[first[:n]] = _START
    short_next = np.zeros(n, bool)
    short_next[:-1] = (state[1:] == _SHORT) & ~first[1:n]
    white = cls <= _WHITE
    white_before = (prev == _AFTER_SPACE) | (prev == _AFTER_WHITE)
    last_white = np.zeros(n, bool)
    last_white[:-1] = ~white[1:] & ~first[1:n]
    number, letter = cls == _NUMBER, np.isin(cls, _LETTERS)
    other = (cls == _OTHER) | (cls == _QUOTE)
    grows = (prev == _AFTER_SPACE) & ~white
    grows |= number & (prev == _IN_NUMBERS)
    grows |= other & ((prev == _IN_OTHERS) | (prev == _AT_QUOTE))
    pending = np.isin(state, (_QUOTE_L, _QUOTE_V, _QUOTE_R)) & short_next
    grows |= letter & ((prev == _IN_LETTERS) | np.isin(prev, (_QUOTE_L, _QUOTE_V, _QUOTE_R)) | ((prev == _AT_QUOTE) & ((state == _SHORT) | pending)))
    grows |= white & white_before & ~last_white
    return np.flatnonzero(~grows | first[:n])


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of least rank, the leftmost on ties, is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 48:
        return _merge_short(piece, ranks)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], alive[j], nxt[i] = stop, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            k = nxt[j]
            r = ranks.get(piece[i : end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[k]))
        k = prv[i]
        if k >= 0:
            r = ranks.get(piece[k:stop])
            if r is not None:
                heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    none = 1 << 62
    cuts = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in itertools.pairwise(cuts)]


class PieceCache(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers, in two generations of `most` entries at most."""

    def __init__(self, ranks: dict[bytes, int], most: int = 100_000):
        super().__init__()
        self.ranks, self.most, self.older = ranks, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(merge_piece(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.cache = PieceCache(self.ranks)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lens = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        offs = np.concatenate([[0], np.cumsum(sizes)])
        cuts = boundaries(whole, offs[:-1][sizes > 0])
        edges = [*cuts.tolist(), len(whole)]
        cache = self.cache
        found = [cache[whole[a:b]] for a, b in itertools.pairwise(edges)]
        at = np.searchsorted(cuts, offs).tolist()
        return [b"".join(found[a:b]) for a, b in itertools.pairwise(at)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids, gathered from the vocabulary by the tokens' offsets."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - (ends - lens), lens)].tobytes()


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def token_rows(batches: Iterator[pa.RecordBatch], path: str, text_col: str, keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    enc = codec(path)
    for batch in batches:
        names, texts = batch.schema.names, batch.column(batch.schema.get_field_index(text_col))
        for lo, hi, _, _ in text_slices(batch, text_col, 1 << 20):
            part = ["" if t is None else t for t in texts.slice(lo, hi - lo).to_pylist()]
            ids = enc.encode_many(part)
            cols = [batch.column(names.index(c)).slice(lo, hi - lo) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())], schema=schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `token_ids`: the ids as little-endian unsigned 32-bit integers, for every row.

    Null and empty texts get no ids. Rows are independent, so repeated rows repeat their result, ties can't occur
    and an empty table stays empty; other columns, `token_ids` included, are left out. `path` is a rank file that
    every executor can open. A text is held whole in memory while it is encoded.
    """
    keep = list(keep)
    cols = [F.col(c) for c in keep] + [F.col(text_col).alias("_text")]
    out = docs.select(*cols)
    spark_schema = docs.select(*keep).withColumn("token_ids", F.lit(b"")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)
    return out.mapInArrow(lambda it: token_rows(it, path, "_text", keep, arrow), spark_schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `decoded`: the bytes that the ids of each row stand for; null ids decode to none."""
    keep = list(keep)
    spark_schema = tokens.select(*keep).withColumn("decoded", F.lit(b"")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in batches:
            ids = batch.column(len(keep))
            for lo, hi, _, _ in text_slices(batch, "_ids", 1 << 22):
                part = ids.slice(lo, hi - lo).to_pylist()
                back = [enc.decode(np.frombuffer(x or b"", "<u4")) for x in part]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.array(back, pa.binary())], schema=arrow)

    return tokens.select(*keep, F.col(ids_col).alias("_ids")).mapInArrow(rows, spark_schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids in one pass: `keep`, n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids."""
    keep = list(keep)
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    schema = schema.add("token_ids", "binary") if with_ids else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    inner = pa.schema([*list(arrow)[: len(keep)], ("token_ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(path)
        for batch in token_rows(batches, path, "_text", keep, inner):
            ids = batch.column(len(keep)).to_pylist()
            digests = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(enc.decode(np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
            cols = [*batch.columns[: len(keep)], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [batch.column(len(keep))] * with_ids, schema=arrow)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(rows, schema)

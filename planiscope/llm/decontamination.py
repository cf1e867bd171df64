"""Benchmark decontamination by latent semantic retrieval.

Documents are read in overlapping passages of words; passages and benchmark items are TF-IDF vectors over hashed terms,
with document frequencies over all documents. A randomised SVD, whose products run on the executors, gives the latent
directions of all passages; these are projected onto them, centred and scaled to equal variance per direction, and
compared with all items by cosine. Candidates are then read word by word: longest common subsequence
with the item, and for paraphrases a check that the item's answer, its last sentence, is there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prefix_hash, span_hash, stored, text_slices, window_hash, with_uid, word_bounds


@dataclass(frozen=True)
class Settings:
    """size: hashed terms. rank, extra, rounds: directions, oversampling and power iterations of the SVD.
    sample_docs: None, and the SVD is fitted on all documents; a caller may ask for some so many, by a hash of the id.
    step: words of half a passage.
    near: share of the cosine expected of a passage that holds an item, from which it is a candidate; low enough that
    paraphrases at `same` or `alike` get to the word-by-word reading, which alone decides. rare: share of an item's
    rarer words, by their bits in a small map, that a candidate passage must hold. same: share of an
    item's words in common order that proves it; alike and answer: shares of the item and of its answer that do.
    block: items compared at a time. least: words below which an item has no part that could be told from chance: it is
    found where all its words stand in a row.
    """

    size: int = 1 << 13
    rank: int = 64
    extra: int = 16
    rounds: int = 2
    sample_docs: int | None = None
    step: int = 24
    near: float = 0.25
    rare: float = 0.35
    same: float = 0.7
    alike: float = 0.5
    answer: float = 0.8
    block: int = 20_000
    least: int = 5


# letters and digits in lower case; other ASCII characters part words; bytes of longer characters are kept
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256)], np.uint8)


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of folded words, and their document numbers."""
    folded = _FOLD[buf]
    starts, ends, doc = word_bounds(folded, offs)
    return span_hash(prefix_hash(folded, 4), starts, ends, 4), doc


def words_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return _words(data, np.array([0, len(data)]))[0]


def _blocks(doc: np.ndarray, docs: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and document of every run of `step` words, and the first word of every document."""
    first = np.searchsorted(doc, np.arange(docs + 1))
    sizes = np.diff(first)
    count = -(-sizes // step)
    owner = np.repeat(np.arange(docs), count)
    ends = np.cumsum(count)
    within = np.arange(len(owner)) - np.repeat(ends - count, count)
    return first[owner] + within * step, owner, first


def _once(terms: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of every run, each once, so that a text that repeats a word is not far from all others; first place by run."""
    run = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(terms))))
    key = np.unique(run * size + terms)
    return key & (size - 1), np.searchsorted(key, np.arange(len(at)) * size)


def _runs(terms: np.ndarray, at: np.ndarray, step: int, size: int) -> np.ndarray:
    """Terms of every run in a row, each once; places left over hold `size`."""
    place = np.arange(step)
    sizes = np.diff(np.append(at, len(terms)))
    rows = np.append(terms, size).astype(np.uint16 if size < 1 << 16 else np.uint32)[np.minimum(at[:, None] + place, len(terms))]
    rows[place >= sizes[:, None]] = size
    rows.sort(axis=1)
    again = rows[:, 1:] == rows[:, :-1]
    rows[:, 1:][again] = size
    return rows


def _summed(rows: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of the rows that each row of `index` names, a thousand at a time, so that they stay in the cache."""
    out = np.empty((len(index), rows.shape[1]), rows.dtype)
    for lo in range(0, len(index), 1024):
        part = np.ascontiguousarray(index[lo : lo + 1024].T).astype(np.intp)
        own = out[lo : lo + 1024]
        more = np.empty_like(own)
        np.take(rows, part[0], axis=0, out=own, mode="clip")
        for p in part[1:]:
            own += np.take(rows, p, axis=0, out=more, mode="clip")
    return out


def _segment_sums(rows: np.ndarray, order: np.ndarray, counts: np.ndarray, width: int = 8) -> np.ndarray:
    """Sums of rows[order] over consecutive segments of the given sizes, one or more rows each: `width` at a time."""
    while True:
        blocks = -(-counts // width)
        index = np.full(int(blocks.sum()) * width, len(rows))
        shift = (np.cumsum(blocks) - blocks) * width - (np.cumsum(counts) - counts)
        index[np.arange(len(order)) + np.repeat(shift, counts)] = order
        rows = _summed(np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), index.reshape(-1, width))
        if len(rows) == len(counts):
            return rows
        order, counts = np.arange(len(rows)), blocks


def _passages(terms: np.ndarray, doc: np.ndarray, docs: int, step: int, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the terms' weight rows over every passage of two runs, its number of terms, first word and document."""
    at, owner, first = _blocks(doc, docs, step)
    if not len(at):
        return np.zeros((0, weights.shape[1]), np.float32), at, at, owner, first
    runs = _runs(terms, at, step, len(weights))
    both = _summed(np.vstack([weights, np.zeros((1, weights.shape[1]), weights.dtype)]), runs)
    counts = (runs < len(weights)).sum(axis=1)
    follows = owner[1:] == owner[:-1]
    both[:-1][follows] += both[1:][follows]
    counts[:-1][follows] += counts[1:][follows]
    # a document's last run is a passage only if it is the only one: the one before holds it
    keep = np.ones(len(at), bool)
    keep[1:] = ~(follows & np.append(~follows[1:], True))
    return both[keep], counts[keep], at[keep], owner[keep], first


def run_terms(docs: DataFrame, cfg: Settings) -> DataFrame:
    """(runs, follows) of all documents (uid, text): terms of some runs of words (see _runs), and whether the next run is
    of the same document. A document's runs are in one row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch, "text"):
                words, doc = _words(buf, offs)
                at, owner, _ = _blocks(doc, hi - lo, cfg.step)
                if len(at):
                    runs = _runs((words & np.uint64(cfg.size - 1)).astype(np.int64), at, cfg.step, cfg.size)
                    follows = np.append(owner[1:] == owner[:-1], False)
                    yield pa.RecordBatch.from_arrays([pa.array([runs.tobytes()], pa.binary()), pa.array([follows.tobytes()], pa.binary())], names=["runs", "follows"])

    return docs.select("uid", "text").mapInArrow(rows, "runs binary, follows binary")


def _read_runs(batches: Iterator[pa.RecordBatch], cfg: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for runs, follows in zip(*batch.columns, strict=True):
            yield np.frombuffer(runs.as_buffer(), np.uint16 if cfg.size < 1 << 16 else np.uint32).reshape(-1, cfg.step), np.frombuffer(follows.as_buffer(), bool)


def _frequencies(runs: DataFrame, cfg: Settings) -> np.ndarray:
    """Documents that hold each hashed term, from the rows of `run_terms`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.size + 1, np.int64)
        for terms, follows in _read_runs(batches, cfg):
            doc = np.cumsum(~follows) - ~follows
            for a in range(0, int(doc[-1]) + 1, 128):
                i, j = np.searchsorted(doc, [a, a + 128])
                there = np.zeros((128, cfg.size + 1), np.uint8)
                there[(doc[i:j] - a)[:, None], terms[i:j]] = 1
                total += there.sum(axis=0, dtype=np.uint8)
        at = np.flatnonzero(total[: cfg.size])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(cfg.size, np.int64)
    for r in runs.mapInArrow(rows, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def document_frequencies(docs: DataFrame, cfg: Settings) -> np.ndarray:
    """Documents that hold each hashed term, over all documents (uid, text)."""
    return _frequencies(run_terms(docs, cfg), cfg)


#: Parts in which the executors add up a matrix of terms, so that no task sends the driver more than some 100 KB at a time.
PARTS = 64


def _product(batches: Iterator[pa.RecordBatch], cfg: Settings, idf: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over passages a of (a' q), a, 1 and a's terms, in parts of the terms: what a power iteration needs of a partition."""
    out, times, n = np.zeros((cfg.size, q.shape[1])), np.zeros(cfg.size), 0
    wq = np.vstack([idf[:, None] * q, np.zeros((1, q.shape[1]))]).astype(np.float32)
    for terms, follows in _read_runs(batches, cfg):
        z = _summed(wq, terms)  # of passage i: runs i and i + 1
        z[:-1][follows[:-1]] += z[1:][follows[:-1]]
        back = z.copy()  # a run is in the passages that begin at it and before it
        back[1:][follows[:-1]] += z[:-1][follows[:-1]]
        order = np.argsort(terms, axis=None, kind="stable")
        order = order[: np.count_nonzero(terms < cfg.size)]
        t, run = terms.ravel()[order], order // cfg.step
        cut = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        out[t[cut]] += _segment_sums(back, run, np.diff(np.append(cut, len(t))))
        times += np.bincount(t, (1 + np.append(False, follows[:-1]))[run], cfg.size)
        n += len(terms)
    if n:
        ys, means = np.array_split((idf[:, None] * out).astype(np.float32), PARTS), np.array_split(idf * times, PARTS)
        counts = [n] + [0] * (PARTS - 1), [int(times.sum())] + [0] * (PARTS - 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([y.tobytes() for y in ys], pa.binary()), pa.array([m.tobytes() for m in means], pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=["k", "y", "mean", "n", "held"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of `_product` by part; a task holds the few parts that were dealt to it."""
    sums: dict[int, list] = {}
    for b in batches:
        for k, y, mean, n, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
            row = [np.frombuffer(y, np.float32).astype(float), np.frombuffer(mean), n, held]
            sums[k] = [a + c for a, c in zip(sums[k], row, strict=True)] if k in sums else row
    for k, (y, mean, n, held) in sums.items():
        yield pa.RecordBatch.from_pylist([{"k": k, "y": y.tobytes(), "mean": mean.tobytes(), "n": n, "held": held}], pa.schema([("k", pa.int32()), ("y", pa.binary()), ("mean", pa.binary()), ("n", pa.int64()), ("held", pa.int64())]))


@dataclass(frozen=True)
class Latent:
    """Weight rows of terms (idf, direction and scale in one), the centre to take off, and which terms are rare."""

    weights: np.ndarray
    centre: np.ndarray
    scarce: np.ndarray

    def unit(self, sums: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Unit vectors of passages with given numbers of terms; the centre is that of a passage of as many."""
        x = sums - self.centre * terms[:, None]
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def fit(docs: DataFrame, cfg: Settings = Settings()) -> Latent:
    """Latent directions: document frequencies and a randomised SVD of all documents (uid, text)."""
    runs = stored(run_terms(docs, cfg), "runs")
    df = _frequencies(runs, cfg)
    n = docs.count()
    idf = np.log((1 + n) / (1 + df))
    fitted = runs
    if cfg.sample_docs is not None:
        drawn = docs.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, cfg.sample_docs / max(1, n))))
        fitted = run_terms(drawn, cfg)
    schema = "k int, y binary, mean binary, n long, held long"

    def product(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        sent = docs.sparkSession.sparkContext.broadcast((idf, q))
        partial = fitted.mapInArrow(lambda it: _product(it, cfg, *sent.value), schema)
        rows = partial.repartition(PARTS, "k").mapInArrow(_added, schema).collect()
        sent.destroy()
        rows.sort(key=lambda r: r["k"])
        y, mean, count, held = np.zeros((cfg.size, q.shape[1])), np.zeros(cfg.size), 0, 0
        if rows:
            y = np.concatenate([np.frombuffer(bytes(r["y"])).reshape(-1, q.shape[1]) for r in rows])
            mean = np.concatenate([np.frombuffer(bytes(r["mean"])) for r in rows])
            count, held = (sum(r[c] for r in rows) for c in ("n", "held"))
        mean = mean / max(1, count)
        return y - count * np.outer(mean, mean @ q), mean, count, held

    q = np.random.default_rng(23).standard_normal((cfg.size, cfg.rank + cfg.extra))
    q = np.linalg.qr(q)[0]
    for _ in range(cfg.rounds):
        q = np.linalg.qr(product(q)[0])[0]
    y, mean, count, held = product(q)
    values, turn = np.linalg.eigh(q.T @ y)
    best = np.argsort(values)[::-1][: cfg.rank]
    sd = np.sqrt(np.maximum(values[best], 1e-9) / max(1, count))
    directions = q @ turn[:, best] / sd
    discard(runs)
    return Latent((idf[:, None] * directions).astype(np.float32), (mean @ directions * count / max(1, held)).astype(np.float32), df <= 0.3 * n)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


def items_of(rows: list[tuple[int, str | None]], least: int) -> list[Item]:
    """Items of `least` words or more; the answer is the last of several sentences with three words or more, else the last eight words."""
    out = []
    for item_id, text in rows:
        words = words_of(text)
        if len(words) < least:
            continue
        sentences = [w for w in map(words_of, (text or "").replace("\n", ".").replace("?", ".").replace("!", ".").split(".")) if len(w) >= 3]
        out.append(Item(item_id, words, sentences[-1] if len(sentences) > 1 else words[-8:]))
    return out


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        p = places.get(w)
        if p is not None:
            u = row & p
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def expected(words: np.ndarray, step: int) -> np.ndarray:
    """Cosine between an item and the passage that holds most of it, where that passage is least well placed."""
    size = 2.0 * step
    held = np.where(words <= step, words, np.minimum(size, words - np.minimum(step / 2, (words - step) / 2)))
    return np.minimum(1.0, held / np.sqrt(words * size))


def _query(words: np.ndarray, latent: Latent, cfg: Settings) -> np.ndarray:
    terms, _ = _once((words & np.uint64(cfg.size - 1)).astype(np.int64), np.arange(0, len(words), cfg.step), cfg.size)
    return latent.unit(latent.weights[terms].sum(axis=0, keepdims=True), np.array([len(terms)]))[0]


def _maps(words: np.ndarray, at: np.ndarray, scarce: np.ndarray) -> np.ndarray:
    """For each run of words beginning at `at`, 256 bits of which its rarer words set one each."""
    one = np.where(scarce[(words & np.uint64(len(scarce) - 1)).astype(np.int64)], np.uint64(1) << (words >> np.uint64(58)), np.uint64(0))
    column = (words >> np.uint64(56)) & np.uint64(3)
    return np.stack([np.bitwise_or.reduceat(np.where(column == c, one, np.uint64(0)), at) for c in range(4)], axis=1)


def _rows(out: dict[tuple[int, int], tuple]) -> pa.RecordBatch:
    rows = [(*k, *v) for k, v in out.items()]
    cols = zip(*rows, strict=True) if rows else ([],) * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=["uid", "item_id", "share", "cosine", "answer", "start_word"])


def _short(batches: Iterator[pa.RecordBatch], items: list[Item]) -> Iterator[pa.RecordBatch]:
    """First places of items too short for a passage's cosine: all their words in a row."""
    by_size: dict[int, dict[int, list[Item]]] = {}
    for i in items:
        by_size.setdefault(len(i.words), {}).setdefault(int(window_hash(i.words, len(i.words))[0]), []).append(i)
    for batch in batches:
        uids = batch.column(0).to_numpy()
        out: dict[tuple[int, int], tuple] = {}
        for lo, hi, buf, offs in text_slices(batch, "text"):
            words, doc = _words(buf, offs)
            first = np.searchsorted(doc, np.arange(hi - lo))
            for size, known in by_size.items():
                runs = window_hash(words, size)
                at = np.flatnonzero(np.isin(runs, np.array(list(known), np.uint64)) & (doc[: len(runs)] == doc[size - 1 :]))
                _, places = np.unique(np.stack([doc[at].astype(np.uint64), runs[at]], axis=1), axis=0, return_index=True)
                for p in at[places].tolist():
                    for item in known[int(runs[p])]:
                        if np.array_equal(words[p : p + size], item.words):
                            out[int(uids[lo + doc[p]]), item.item_id] = (1.0, None, 1.0, int(p - first[doc[p]]))
        yield _rows(out)


def _search(batches: Iterator[pa.RecordBatch], latent: Latent, items: list[Item], cfg: Settings) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(i.words) for i in items])
    queries = np.stack([_query(i.words, latent, cfg) for i in items])
    bar = (cfg.near * expected(sizes.astype(float), cfg.step)).astype(np.float32)
    sets = [set(i.words.tolist()) for i in items]
    maps = np.concatenate([_maps(i.words, np.array([0]), latent.scarce) for i in items])
    need = np.ceil(cfg.rare * np.bitwise_count(maps).sum(axis=1))
    span_of = max(1, min(2048, (1 << 22) // len(items)))  # passages at a time: what passes the bar is held with the cosines
    for batch in batches:
        uids = batch.column(0).to_numpy()
        out: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for lo, hi, buf, offs in text_slices(batch, "text"):
            words, doc = _words(buf, offs)
            terms = (words & np.uint64(cfg.size - 1)).astype(np.int64)
            sums, count, at, owner, first = _passages(terms, doc, hi - lo, cfg.step, latent.weights)
            if not len(at):
                continue
            stop = np.minimum(at + 2 * cfg.step, first[owner + 1])
            x = latent.unit(sums, count)
            # a passage shorter than an item may hold all of itself only
            short = np.sqrt(np.minimum(1.0, (stop - at) / (2.0 * cfg.step))).astype(np.float32)
            edges = np.stack([at, stop], axis=1).ravel()
            own = _maps(np.append(words, np.uint64(0)), edges, latent.scarce)[::2]
            for p0 in range(0, len(at), span_of):
                cos = x[p0 : p0 + span_of] @ queries.T
                ps, qs = np.nonzero(cos >= bar * short[p0 : p0 + span_of, None])
                held = np.bitwise_count(own[p0 + ps] & maps[qs]).sum(axis=1) >= need[qs] * np.minimum(1.0, (stop - at)[p0 + ps] / sizes[qs])
                for p, q in zip(ps[held].tolist(), qs[held].tolist(), strict=True):
                    p += p0
                    item = items[q]
                    reach = len(item.words)
                    d = owner[p]
                    a, b = max(int(first[d]), int(at[p]) - reach), min(int(first[d + 1]), int(stop[p]) + reach)
                    region = words[a:b].tolist()
                    if len(sets[q].intersection(region)) < cfg.alike * len(sets[q]):
                        continue
                    target = item.words.tolist()
                    share, where = 0.0, a
                    span = len(target) + len(target) // 2
                    for s in range(0, max(1, len(region) - len(target) + 1), max(1, len(target) // 4)):
                        got = common_words(target, region[s : s + span]) / len(target)
                        if got > share:
                            share, where = got, a + s
                    if share < cfg.alike:
                        continue
                    answer = item.answer.tolist()
                    held = common_words(answer, words[where : min(where + span, int(first[d + 1]))].tolist()) / len(answer)
                    if share >= cfg.same or held >= cfg.answer:
                        key = (int(uids[lo + d]), item.item_id)
                        new = (share, float(cos[p - p0, q]), held, int(where - first[d]))
                        if key not in out or new[0] > out[key][0]:
                            out[key] = new
        yield _rows(out)


def _found(batches: Iterator[pa.RecordBatch], latent: Latent | None, items: list[Item], cfg: Settings) -> Iterator[pa.RecordBatch]:
    long, short = ([i for i in items if (len(i.words) >= cfg.least) == side] for side in (True, False))
    for batch in batches:
        if long:
            yield from _search(iter([batch]), latent, long, cfg)
        if short:
            yield from _short(iter([batch]), short)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Settings = Settings()) -> DataFrame:
    """(doc_id, uid, item_id, share, cosine, answer, start_word): documents that hold benchmark items, a row per pair.

    share is the best part of the item's words found in common order, answer that of its answer's words in the same
    place. Case and ASCII punctuation do not count. Null and empty texts match nothing, and neither do items without a
    word. Items of fewer than cfg.least words are found where all their words stand in a row; their cosine is null. Repeated
    items count once each with their ids, the best place wins and the first on ties. Rows are told apart by uid, so
    rows that repeat an id or all of a row each give theirs. Empty tables give an empty result; other columns are left
    out. Items are searched in blocks of cfg.block, so what is sent to the workers has a fixed bound; words are compared
    by 64-bit hashes.
    """
    rows = with_uid(docs, id_col, text_col)
    spark = docs.sparkSession
    schema = "uid long, item_id long, share double, cosine double, answer double, start_word long"
    found = spark.createDataFrame([], schema)
    latent: Latent | None = None

    def search(block: list[Item]) -> DataFrame:
        nonlocal latent
        if latent is None and any(len(i.words) >= cfg.least for i in block):
            latent = fit(rows, cfg)
        sent = spark.sparkContext.broadcast((latent, block))
        out = stored(rows.select("uid", "text").mapInArrow(lambda it: _found(it, *sent.value, cfg), schema), "contaminated")
        sent.destroy()
        return out

    block: list[Item] = []
    for r in benchmark.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        block += items_of([(r[0], r[1])], 1)
        if len(block) == cfg.block:
            found, block = found.unionByName(search(block)), []
    if block:
        found = found.unionByName(search(block))
    best = found.groupBy("uid", "item_id").agg(F.max(F.struct("share", "cosine", "answer", (-F.col("start_word")).alias("s"))).alias("b"))
    ids = rows.select("uid", F.col("id").alias("doc_id"))
    return best.select("uid", "item_id", "b.share", "b.cosine", "b.answer", (-F.col("b.s")).alias("start_word")).join(ids, "uid")

"""Language identification by hierarchical discrimination.

A first model tells the language family, a second step tells apart the languages within it: one linear support vector
machine for each pair of the family's languages, decided by their votes. Families are a fixed table of ISO 639-1 codes;
labels that it lacks form a family of their own. Features are hashed character n-grams of lowered words, so no
vocabulary grows with the data and a text of any length becomes one vector of fixed size. All labelled rows are learned
from: the executors add up losses and gradients over them, the driver takes the steps.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, mixed, stored

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "co", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu", "se"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}
#: Features: a power of two.
SIZE = 1 << 12
UNDETERMINED = "und"


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), "other")


@functools.lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 0x34000, which hold all letters: is it a letter, and its lower-case form where that is one code point."""
    top = 0x34000
    letter = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for cp in range(top):
        c = chr(cp)
        if unicodedata.category(c)[0] == "L":
            letter[cp] = True
            low = c.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    return letter, lower


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the hashed n-grams (1 to 4 letters, words padded) of each text, and which texts have a letter."""
    is_letter, lower = _letters()
    whole = "\n".join("" if t is None else t for t in texts) + "\n"
    cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    letter = is_letter[cps]
    use = letter.copy()
    use[1:] |= letter[:-1]
    use[:-1] |= letter[1:]  # the break before and after a word pads it; runs of breaks shrink to their ends
    sym = np.where(letter, lower[cps], 0)[use].astype(np.uint64)
    row, letter = np.repeat(np.arange(len(texts)) * SIZE, sizes)[use], letter[use]
    out = np.zeros(len(texts) * SIZE + 1, np.int64)  # the last one takes what is no n-gram
    h = np.zeros(len(sym), np.uint64)
    for n in range(1, min(4, len(sym)) + 1):
        size = len(sym) - n + 1
        h = mixed(h[:size] * np.uint64(0x100000001B3) + (sym[n - 1 :] + np.uint64(n)))
        ok = (row[:size] == row[n - 1 :]) & (letter[:size] | letter[n - 1 :])
        for j in range(1, n - 1):  # an n-gram may begin or end with a break, no more
            ok &= letter[j : j + size]
        place = (h >> np.uint64(52)).view(np.int64)
        place += row[:size]
        np.putmask(place, ~ok, len(out) - 1)
        out += np.bincount(place, minlength=len(out))
    has = np.zeros(len(texts), bool)
    has[np.unique(row[letter]) // SIZE] = True
    return out[:-1].reshape(len(texts), SIZE), has


def unit(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted counts."""
    out = counts.astype(np.float32)
    norm = np.sqrt(out.sum(axis=1, keepdims=True))
    np.sqrt(out, out=out)
    out /= np.maximum(norm, 1e-9)
    return out


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square-rooted n-gram counts, and which texts have a letter."""
    counts, has = gram_counts(texts)
    return unit(counts), has


def packed(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Rows of counts in little room: a compressed byte for each count, and the places and counts of those over 255."""
    over = np.flatnonzero(counts > 255)
    return pa.compress(np.minimum(counts, 255).astype(np.uint8), "zstd", asbytes=True), over.astype(np.int64).tobytes(), counts.ravel()[over].astype(np.int64).tobytes()


def unpacked(rows: int, small: bytes, over: bytes, large: bytes) -> np.ndarray:
    """What `packed` was given, as float32."""
    out = np.frombuffer(pa.decompress(small, rows * SIZE, "zstd"), np.uint8).astype(np.float32)
    out[np.frombuffer(over, np.int64)] = np.frombuffer(large, np.int64)
    return out.reshape(rows, SIZE)


def _blocks(texts: list[str | None], limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` characters and at most 128 texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < 128 and (end == at or size + len(texts[end] or "") <= limit):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def linear_svm(x: np.ndarray, y: np.ndarray, epochs: int = 30, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss, classes balanced), by dual coordinate descent."""
    n = len(y)
    x = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    cost = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y <= 0).sum())) * c
    q = (x * x).sum(axis=1)
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(n):
            grad = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - grad / q[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w += step * y[i] * x[i]
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    families: list[str]
    family_w: np.ndarray  # one row per family, one against the rest
    family_b: np.ndarray
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, np.ndarray, float]]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Label and score of each vector: the product of a logistic of the family's lead and of the language's."""
        margin = x @ self.family_w.T + self.family_b
        best = margin.argmax(axis=1)
        lead = np.full(len(x), 4.0)
        if len(self.families) > 1:
            top = np.sort(margin, axis=1)
            lead = top[:, -1] - top[:, -2]
        out, score = np.empty(len(x), object), 1 / (1 + np.exp(-2 * lead))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            langs = self.langs[name]
            votes, gap = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for i, j, w, b in self.pairs[name]:
                m = x[rows] @ w + b
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                gap[:, i] += m
                gap[:, j] -= m
            pick = (votes + 1e-3 * np.tanh(gap)).argmax(axis=1)
            for r, p in zip(rows.tolist(), pick.tolist(), strict=True):
                out[r] = langs[p]
            if len(langs) > 1:
                score[rows] *= 1 / (1 + np.exp(-2 * np.abs(gap[np.arange(len(rows)), pick]) / (len(langs) - 1)))
        return list(out), score


#: Width over which the hinge is rounded, so that it has a gradient everywhere.
ROUNDED = 0.5
#: Rows of vectors that are stored, and added up, as one.
BLOCK = 512
#: Parts in which executors add up gradients. Steps that the driver remembers, and passes over the rows at most.
PARTS, MEMORY, PASSES = 16, 6, 80
#: Length of the gradient, as a share of the weights', at which a machine is done. The objective's curvature is one at
#: least, so the weights are then within this share of the best ones.
CLOSE = 0.03


def machines(langs: list[str]) -> tuple[list[str], list[tuple[str, int, int]], np.ndarray]:
    """Families, pairs of languages (family, places within it), and by language and machine the side: 1, -1, or 0 if the
    machine does not see the language. The first machines tell a family from the rest, the others the pairs apart."""
    own = [family_of(v) for v in langs]
    families = sorted(set(own))
    within = {f: [i for i, o in enumerate(own) if o == f] for f in families}
    pairs = [(f, i, j) for f in families for i in range(len(within[f])) for j in range(i + 1, len(within[f]))]
    side = np.zeros((len(langs), len(families) + len(pairs)))
    if len(families) > 1:
        for k, f in enumerate(families):
            side[:, k] = [1 if o == f else -1 for o in own]
    for k, (f, i, j) in enumerate(pairs, len(families)):
        side[within[f][i], k], side[within[f][j], k] = 1, -1
    return families, pairs, side


def row_costs(side: np.ndarray, counts: np.ndarray, per_lang: int) -> np.ndarray:
    """Cost of a row by language and machine: a language counts as `per_lang` rows, or as those it has if fewer, however
    many share that; and a machine's two sides count alike."""
    worth = np.minimum(counts, per_lang).astype(float)[:, None] * (side != 0)
    out = np.zeros(side.shape)
    for s in (1, -1):
        here = worth * (side == s)
        out += here * worth.sum(axis=0) / 2 / np.maximum(here.sum(axis=0), 1)
    return out / np.maximum(counts, 1)[:, None]


def losses(x: np.ndarray, lang: np.ndarray, side: np.ndarray, cost: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each machine's summed loss and its gradient (features and bias by machine) over rows with their languages' numbers."""
    s, c = side[lang], cost[lang]
    short = 1 - s * (x @ w[:-1] + w[-1])
    bent = np.clip(short, 0, ROUNDED)
    slope = (c * s * bent / ROUNDED).astype(np.float32)
    return (c * bent * (short - bent / 2) / ROUNDED).sum(axis=0, dtype=float), -np.vstack([x.T @ slope, slope.sum(axis=0)]).astype(float)


def curvature(sums: np.ndarray, squares: np.ndarray, counts: np.ndarray, cost: np.ndarray):
    """A function that divides gradients (features and bias by machine) by a rough curvature of the objectives: of each
    feature by its variance within the languages, and along the languages' means. sums, squares: features by language."""
    mean = sums / counts
    within = np.maximum(squares / counts - mean * mean, 0)
    share = cost * counts[:, None]
    parts = []
    for c in share.T:
        d, u = 1 + within @ c, mean * np.sqrt(c)
        parts.append((d, u, np.linalg.inv(np.eye(len(c)) + u.T @ (u / d[:, None]))))

    def divided(g: np.ndarray) -> np.ndarray:
        out = np.empty_like(g)
        for k, (d, u, core) in enumerate(parts):
            v = g[:, k] / d
            out[:, k] = v - u @ (core @ (u.T @ v)) / d
        return out

    return divided


def minimised(value, w: np.ndarray, divided=lambda g: g) -> np.ndarray:
    """Columns that each minimise their own |w|^2 / 2 + loss, where value(w) gives all columns' losses and gradients: by
    limited-memory BFGS, one call a step; a column whose step does not lower its objective tries half of it. `divided`
    gives the first step and the shape of those to come."""

    def full(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, g = value(w)
        return f + (w * w).sum(axis=0) / 2, g + w

    dot = lambda a, b: (a * b).sum(axis=0)
    f, g = full(w)
    past: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    way, t = -divided(g), np.ones(w.shape[1])
    for _ in range(PASSES):
        open_ = np.sqrt(dot(g, g)) > CLOSE * np.maximum(0.1, np.sqrt(dot(w, w)))
        if not open_.any():
            break
        new = w + way * t * open_
        f1, g1 = full(new)
        good = open_ & (f1 <= f + 1e-4 * t * dot(g, way))
        s, y = np.where(good, new - w, 0), np.where(good, g1 - g, 0)
        curve = dot(s, y)
        past = [*past, (s, y, np.where(curve > 0, 1 / np.where(curve > 0, curve, 1), 0))][-MEMORY:]
        w, g, f = np.where(good, new, w), np.where(good, g1, g), np.where(good, f1, f)
        r, kept = g.copy(), []
        for s, y, rho in reversed(past):
            a = rho * dot(s, r)
            r -= a * y
            kept.append(a)
        scale = np.ones(w.shape[1])
        for s, y, rho in past:
            scale = np.where(rho > 0, 1 / np.where(rho > 0, rho * dot(y, divided(y)), 1), scale)
        r = divided(r) * scale
        for (s, y, rho), a in zip(past, reversed(kept), strict=True):
            r += s * (a - rho * dot(y, r))
        way, t = np.where(good, -r, way), np.where(good, 1.0, t / 2)
    return w


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that must not be learned from: crc32 of the id as text leaves 1 modulo 3; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> Model | None:
    """Fit on the whole texts of all rows with a label that are not held out; None if none has a letter.

    Their counts are stored, packed in blocks of rows, and every step reads them all; the driver gets the machines'
    gradients, never rows.
    `per_lang` is what a label's rows count for together against the shortness of the weights, see `row_costs`: it fixes
    how far scores spread, whatever the size of the table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter(~held_out("id") & F.col("lang").isNotNull())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: list[str] = []
        waiting: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            whole = np.vstack(waiting)
            small, over, large = packed(whole[:BLOCK])
            out = pa.RecordBatch.from_arrays([pa.array([langs[:BLOCK]], pa.list_(pa.string())), *(pa.array([v], pa.binary()) for v in (small, over, large))], names=["langs", "small", "over", "large"])
            del langs[:BLOCK]
            waiting[:] = [whole[BLOCK:].copy()]
            return out

        for batch in batches:
            own, texts = (c.to_pylist() for c in batch.columns)
            for lo, hi in _blocks(texts):
                counts, has = gram_counts(texts[lo:hi])
                langs += [v for v, ok in zip(own[lo:hi], has, strict=True) if ok]
                waiting.append(counts[has])
                if len(langs) >= BLOCK:
                    yield block()
        if langs:
            yield block()

    learned = stored(rows.select("lang", "text").mapInArrow(part, "langs array<string>, small binary, over binary, large binary"), "language-vectors")
    counts = {r["lang"]: r["n"] for r in learned.select(F.explode("langs").alias("lang")).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        discard(learned)
        return None
    langs = sorted(counts)
    families, pairs, side = machines(langs)
    cost = row_costs(side, np.array([counts[v] for v in langs]), per_lang)
    place = {v: i for i, v in enumerate(langs)}
    schema = "k int, loss binary, gradient binary"
    arrow = pa.schema([("k", pa.int32()), ("loss", pa.binary()), ("gradient", pa.binary())])

    def in_parts(loss: np.ndarray, gradient: np.ndarray) -> pa.RecordBatch:
        cut = np.array_split(gradient, PARTS)
        return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([loss.astype(float).tobytes()] + [np.zeros(len(loss)).tobytes()] * (PARTS - 1), pa.binary()), pa.array([c.tobytes() for c in cut], pa.binary())], schema=arrow)

    def summed(batches: Iterator[pa.RecordBatch], f) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                own, *parts = (c[i].as_py() for c in batch.columns)
                more = f(unit(unpacked(len(own), *parts)), np.array([place[v] for v in own], np.int64))
                total = [a + b for a, b in zip(total, more, strict=True)] if total else more
        if total:
            yield in_parts(*total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = [a + np.frombuffer(b) for a, b in zip(sums[k], row, strict=True)] if k in sums else [np.frombuffer(b) for b in row]
        for k, (loss, gradient) in sums.items():
            yield pa.RecordBatch.from_pylist([{"k": k, "loss": loss.tobytes(), "gradient": gradient.tobytes()}], arrow)

    few = learned.rdd.getNumPartitions() <= PARTS

    def over_rows(f, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of a vector and of a matrix of features that f(vectors, languages, *more) gives for some rows, over all."""
        sent = spark.sparkContext.broadcast(more)
        partial = learned.mapInArrow(lambda it: summed(it, lambda x, lang: f(x, lang, *sent.value)), schema)
        found = (partial if few else partial.repartition(PARTS, "k").mapInArrow(added, schema)).collect()
        sent.destroy()
        loss, gradient = (sorted((r["k"], bytes(r[c])) for r in found) for c in ("loss", "gradient"))
        total = [sum(np.frombuffer(v) for k, v in gradient if k == p) for p in range(PARTS)]
        return sum(np.frombuffer(v) for _, v in loss), np.concatenate(total).reshape(SIZE + 1, -1)

    def moments(x: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (lang[:, None] == np.arange(len(langs))).astype(np.float32)
        n = own.sum(axis=0)
        return np.zeros(1), np.hstack([np.vstack([x.T @ own, n]), np.vstack([(x * x).T @ own, n])]).astype(float)

    def value(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return over_rows(losses, side, cost, w.astype(np.float32))

    w = np.zeros((SIZE + 1, side.shape[1]))
    if side.any():
        sums, squares = np.hsplit(over_rows(moments)[1], 2)
        w = minimised(value, w, curvature(sums, squares, np.array([counts[v] for v in langs]), cost))
    discard(learned)
    n = len(families)
    return Model(families, w[:-1, :n].T.copy(), w[-1, :n].copy(), {f: [v for v in langs if family_of(v) == f] for f in families}, {f: [(i, j, w[:-1, k].copy(), float(w[-1, k])) for k, (g, i, j) in enumerate(pairs, n) if g == f] for f in families})


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred and score of every whole text; `und` and 0 for null texts and texts without a letter.

    Only the text is looked at. Rows are independent: repeated rows repeat their result and an empty table gives none.
    Votes that tie go to the larger margin. Without a model every row is `und`. The model is sent to the workers: its
    size is that of the labels, not of the data.
    """
    out = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    arrow = to_arrow_schema(out)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            texts = batch.column(len(keep)).to_pylist()
            for lo, hi in _blocks(texts):
                x, has = vectors(texts[lo:hi])
                langs, score = m.predict(x) if m else ([UNDETERMINED] * (hi - lo), np.zeros(hi - lo))
                langs = [v if ok else UNDETERMINED for v, ok in zip(langs, has, strict=True)]
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(np.where(has, score, 0.0), pa.float64())], schema=arrow)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(rows, out)

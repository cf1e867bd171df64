import hashlib
import random

import numpy as np
import pytest

from planiscope.llm import substring_dedup, suffix_dedup


def plain_suffix(docs, length):
    order = sorted(docs, key=lambda d: d[0])
    seen, out = set(), {}
    for i, t in order:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                gone[a : a + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def words_of(t):
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def plain_words(docs, length):
    places = {}
    for i, t in docs:
        w = words_of(t or "")
        for a in range(len(w) - length + 1):
            places.setdefault(tuple(w[a : a + length]), []).append((i, a))
    gone = {i: set() for i, _ in docs}
    for at in places.values():
        if len(at) > 1:
            for i, a in at:
                gone[i].update(range(a, a + length))
    out = {}
    for i, t in docs:
        w = words_of(t or "")
        kept = " ".join(x for j, x in enumerate(w) if j not in gone[i])
        out[i] = (len(w), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n=60, vocabulary=400):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(vocabulary)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passages = [text(rnd.randint(20, 90)) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [text(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            parts += [rnd.choice(passages), text(rnd.randint(0, 30))]
        docs.append((i * 3, rnd.choice([" ", "\n", " \t "]).join(parts)))
    docs += [(1000 + i, docs[7][1]) for i in range(12)] + [(2000, ""), (2001, None), (2002, "ab " * 300), (2003, " \n"), (2004, "x" * 450), (2005, docs[3][1].replace("a", "b", 1))]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,length,chunk", [(1, 100, 8192), (2, 100, 16), (3, 20, 16)])
def test_bytes_against_plain_code(spark, seed, length, chunk):
    docs = corpus(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(table, length=length, chunk=chunk).collect()}
    assert got == plain_suffix(docs, length)


@pytest.mark.parametrize("seed,length", [(4, 35), (5, 35), (6, 11), (7, 6), (8, 50)])
def test_words_against_plain_code(spark, seed, length):
    docs = corpus(seed)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(table, length=length).collect()}
    assert got == plain_words(docs, length)


def test_hot_anchor(spark):
    """A passage inside several hundred different texts: suffixes of one beginning fill many parts of a bucket."""
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20)) + " " + passage + " " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(table).collect()}
    assert got == plain_words(docs, 35)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(table, chunk=32).collect()}
    assert got == plain_suffix(docs, 100)


def test_null_and_repeated_ids_empty_tables_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, long, 1), (4, long, 2), (4, long, 3), (4, "short", 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid long")
    got = sorted((r.id if r.id is not None else -1, r.n_removed) for r in substring_dedup.deduplicate(docs).collect())
    assert got == [(-1, 0), (-1, 80), (4, 0), (4, 80), (4, 80)]
    got = sorted((r.id if r.id is not None else -1, r.n_removed) for r in suffix_dedup.deduplicate(docs).collect())
    assert got == [(-1, 0), (-1, 0), (4, 0), (4, len(long)), (4, len(long))]
    empty = docs.filter("false")
    assert substring_dedup.deduplicate(empty).collect() == [] and suffix_dedup.deduplicate(empty).collect() == []


def test_kept_text(spark):
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"Head\n{long}\nTail  end"), (2, f"{long} é")], "doc_id long, text string")
    got = {r.id: r.kept for r in substring_dedup.deduplicate(docs, with_text=True).collect()}
    assert got == {1: "Head\nTail  end", 2: "é"}
    got = {r.id: r.kept for r in suffix_dedup.deduplicate(docs, with_text=True).collect()}
    assert got[1].decode() == docs.collect()[0].text and got[2].decode() == " é"


def test_multikey_quicksort():
    rnd = np.random.default_rng(3)
    for n, values in ((0, 3), (1, 3), (500, 2), (500, 4), (300, 1)):
        strings = rnd.integers(0, values, (n, 5)).astype(np.uint64)
        order, lo, size = suffix_dedup.multikey_sort(strings[:, 0], 4, lambda d, i: strings[i, d + 1])
        rows = [tuple(r) for r in strings[order].tolist()]
        assert rows == sorted(map(tuple, strings.tolist()))
        equal = [False] * n
        for a, k in zip(lo.tolist(), size.tolist()):
            equal[a + 1 : a + k] = [True] * (k - 1)
        assert equal == [i > 0 and rows[i] == rows[i - 1] for i in range(n)]


def test_long_texts(spark):
    """Texts of over a megabyte are read in parts; repeats across the parts and in other documents are found."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(10**7)}" for _ in range(250_000)]
    one, two = " ".join(words), " ".join(words[100_000:160_000] + [f"v{i}" for i in range(1000)] + words[100_010:100_200])
    docs = [(1, one), (2, two), (3, "a" * 1_500_000), (4, " ".join(words[70:110]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.deduplicate(table).collect()}
    assert got == plain_words(docs, 35)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(table).collect()}
    assert got == plain_suffix(docs, 100)

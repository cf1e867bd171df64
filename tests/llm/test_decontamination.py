import random

import numpy as np
import pyarrow as pa

from planiscope.llm import decontamination as d

CFG = d.Settings(size=1 << 11, rank=24, extra=8, sample_docs=500)


def make(seed=3):
    rnd = random.Random(seed)
    rare = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "in", "to", "that", "is", "it"]
    words = lambda n: [rnd.choice(common) if rnd.random() < 0.35 else rnd.choice(rare) for _ in range(n)]
    items = [(i, ". ".join([" ".join(words(rnd.randint(10, 30))).capitalize(), " ".join(words(6)).capitalize()]) + ".") for i in range(12)]
    docs, planted = [], set()
    for i in range(400):
        body = words(rnd.randint(0, 300))
        if i % 20 == 0:
            k = rnd.randrange(12)
            at = rnd.randint(0, len(body))
            body[at:at] = items[k][1].split()
            planted.add((i, k))
        docs.append((i, rnd.choice([" ", "\n"]).join(body)))
    return docs, items, planted, words


def plain_lcs(a, b):
    size = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
    return size[-1, -1]


def test_common_words_against_plain_code():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(0, 15))] for _ in range(2))
        assert d.common_words(a, b) == plain_lcs(a, b)


def test_recall_and_precision_against_plain_search(spark):
    docs, items, planted, words = make()
    table = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in d.contaminated(table, bench, cfg=CFG).collect()}
    norm = lambda t: " ".join(d.words_of(t).astype(str))
    exact = {(i, k) for i, t in docs for k, q in items if norm(q) in norm(t)}
    assert planted <= exact and len(exact & set(found)) >= 0.9 * len(exact)
    assert set(found) <= exact
    assert all(r.share == 1 and r.answer == 1 for r in found.values())
    blocks = d.contaminated(table, bench, cfg=d.Settings(**{**CFG.__dict__, "block": 5})).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(found)


def test_paraphrases_by_order_and_answer(spark):
    docs, items, _, words = make(5)
    rnd = random.Random(8)
    clean = [(i, t) for i, t in docs if i % 20]
    k, q = max(items, key=lambda x: len(x[1]))
    w = q.split()
    close = [x if rnd.random() > 0.2 else "other" for x in w]
    shuffled = rnd.sample(w, len(w))
    extra = [(1000, " ".join([*words(60), *close, *words(60)])), (1001, " ".join([*words(60), *shuffled, *words(60)]))]
    table = spark.createDataFrame(clean + extra, "doc_id long, text string")
    got = [(r.doc_id, r.item_id) for r in d.contaminated(table, spark.createDataFrame(items, "item_id long, text string"), cfg=CFG).collect()]
    assert got == [(1000, k)]


def plain_proof(item, words, cfg):
    """Best common share over windows at every place, as 'same', 'answer' or None: no gate before it."""
    target, answer, best = item.words.tolist(), item.answer.tolist(), (0.0, 0)
    span = len(target) * 3 // 2
    for s in range(max(1, len(words) - len(target) + 1)):
        best = max(best, (d.common_words(target, words[s : s + span]) / len(target), -s))
    share, s = best[0], -best[1]
    held = d.common_words(answer, words[s : s + span]) / len(answer)
    return "same" if share >= cfg.same else "answer" if share >= cfg.alike and held >= cfg.answer else None


def test_recall_of_paraphrases_against_brute_force():
    _, items, _, words = make(5)
    rnd = random.Random(8)
    rows = []
    for n, (_, q) in enumerate(items):
        w = q.split()
        for j in range(30):
            keep, held = (0.78, 0) if j % 2 else (0.5, 6)
            close = [x if i >= len(w) - held or rnd.random() < keep else rnd.choice(words(1)) for i, x in enumerate(w)]
            rows.append((n, " ".join([*words(rnd.randint(20, 80)), *close, *words(rnd.randint(20, 80))])))
    listed = d.items_of(items, CFG.least)
    truth = {(i, listed[n].item_id): kind for i, (n, t) in enumerate(rows) if (kind := plain_proof(listed[n], d.words_of(t).tolist(), CFG))}
    # directions that know nothing of the items, so that cosines scatter as those of a large corpus do
    weights = np.random.default_rng(2).standard_normal((CFG.size, 12)).astype(np.float32)
    latent = d.Latent(weights, np.zeros(12, np.float32), np.ones(CFG.size, bool))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array([t for _, t in rows])], names=["uid", "text"])
    got = pa.Table.from_batches(d._search(iter([batch]), latent, listed, CFG))
    found = set(zip(got.column("uid").to_pylist(), got.column("item_id").to_pylist(), strict=True))
    for kind in ("same", "answer"):
        proved = {x for x, v in truth.items() if v == kind}
        assert len(proved) > 60 and len(proved & found) >= 0.9 * len(proved), (kind, len(proved & found), len(proved))
    assert found <= set(truth)


def test_latent_directions_are_those_of_a_dense_svd(spark):
    docs, _, _, _ = make(6)
    table = spark.createDataFrame([(i, t) for i, t in docs[:80]], "uid long, text string")
    cfg = d.Settings(size=256, rank=4, extra=12, rounds=4, sample_docs=1000)
    latent = d.fit(table, cfg)
    df = d.document_frequencies(table, cfg)
    held = [{int(x) & 255 for x in d.words_of(t)} for _, t in docs[:80]]
    assert df.tolist() == [sum(k in h for h in held) for k in range(256)]
    idf = np.log((1 + 80) / (1 + df))
    rows = []
    for _, t in docs[:80]:
        w = (d.words_of(t) & np.uint64(255)).astype(int)
        runs = [np.bincount(np.unique(w[a : a + 24]), minlength=256) for a in range(0, len(w), 24)]
        rows += [r + (runs[i + 1] if i + 1 < len(runs) else 0) for i, r in enumerate(runs)]
    a = np.array(rows) * idf
    a = a - a.mean(axis=0)
    s = np.linalg.svd(a, compute_uv=False)
    mine = latent.weights / idf[:, None]
    q = np.linalg.qr(mine)[0]
    # single directions of near-equal strength may turn into each other; what they explain together may not change
    assert ((a @ q) ** 2).sum() > 0.97 * (s[:4] ** 2).sum()
    assert np.allclose(((a @ mine) ** 2).mean(axis=0), 1, rtol=0.05)


def test_nulls_empties_and_repeated_rows(spark):
    docs, items, planted, _ = make()
    i, text = next((i, t) for i, t in docs if i % 20 == 0)
    rows = docs + [(i, text), (None, text), (900, None), (901, ""), (902, " . ")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, "never there"), (None, items[0][1]), (52, " !? ")], "item_id long, text string")
    got = d.contaminated(table, bench, cfg=CFG).collect()
    keys = [(r.doc_id, r.item_id, r.uid) for r in got]
    assert len(keys) == len(set(keys)) and any(r.doc_id is None for r in got) and not any(r.doc_id in (900, 901, 902) for r in got)
    assert d.contaminated(table.filter("false"), bench, cfg=CFG).collect() == []
    assert d.contaminated(table, bench.filter("false"), cfg=CFG).collect() == []


def test_short_items_are_found_word_by_word(spark):
    rows = [(1, "He said: Forty-two!"), (2, "forty one two"), (3, "x forty two y forty two"), (3, "Paris."), (4, "forty"), (5, None), (6, "two forty")]
    bench = [(1, "Forty two"), (2, "paris"), (3, "is it so"), (4, "")]
    got = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), cfg=CFG).collect()
    assert sorted((r.doc_id, r.item_id, r.share, r.start_word) for r in got) == [(1, 1, 1.0, 2), (3, 1, 1.0, 1), (3, 2, 1.0, 0)]

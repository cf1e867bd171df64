"""Models are learned from all rows, not from a part of them."""

import random
import zlib

import numpy as np

from planiscope.llm import decontamination as d
from planiscope.llm import language_id as lid


def test_latent_directions_have_unit_variance_over_all_passages(spark):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abcdefghijk") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rnd.choice(vocabulary[: rnd.choice([20, 80, 400])]) for _ in range(rnd.randint(0, 60))) for _ in range(6000)]
    cfg = d.Settings(size=256, rank=4, extra=12)
    latent = d.fit(spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(3), cfg)
    rows, held = [], np.zeros(256)
    for t in texts:
        w = (d.words_of(t) & np.uint64(255)).astype(int)
        held[np.unique(w)] += 1
        runs = [np.bincount(np.unique(w[a : a + 24]), minlength=256) for a in range(0, len(w), 24)]
        rows += [r + (runs[i + 1] if i + 1 < len(runs) else 0) for i, r in enumerate(runs)]
    idf = np.log((1 + len(texts)) / (1 + held))
    a = np.array(rows) * idf
    x = a @ (latent.weights / idf[:, None])
    assert np.allclose(x.var(axis=0), 1, rtol=1e-4)
    assert np.allclose(latent.centre * np.array(rows).sum() / len(rows), x.mean(axis=0), rtol=1e-3, atol=1e-4)


def test_sums_over_named_rows_against_plain_code():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 5))
    counts = np.array([1, 70, 8, 9, 600])
    order = rng.integers(0, 40, counts.sum())
    want = np.add.reduceat(rows[order], np.cumsum(counts) - counts, axis=0)
    assert np.allclose(d._segment_sums(rows, order, counts), want)
    terms = np.array([3, 1, 3, 7, 7, 2, 0])
    assert d._runs(terms, np.array([0, 4, 6]), 4, 8).tolist() == [[1, 3, 8, 7], [2, 7, 8, 8], [0, 8, 8, 8]]


def test_languages_are_learned_from_all_rows(spark):
    rnd = random.Random(9)
    plain = {"de": "abcdefgh", "en": "ghijklmn", "fr": "mnopqrst"}
    rare = {"de": "αβγδε", "en": "бвгдж", "fr": "אבגדה"}
    words = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))
    rows = []
    for i in range(2400):
        lang = rnd.choice(list(plain))
        rows.append((i, words((rare if i % 80 < 2 else plain)[lang], 12), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = lid.train(docs, per_lang=20)
    got, _ = model.predict(lid.vectors([words(rare[v], 30) for v in rare for _ in range(10)])[0])
    assert got == [v for v in rare for _ in range(10)]
    # no machine can be bettered on the rows that may be learned from
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    langs = sorted(plain)
    x, _ = lid.vectors([r[1] for r in used])
    lang = np.array([langs.index(r[2]) for r in used])
    families, pairs, side = lid.machines(langs)
    assert families == ["germanic", "romance"] and pairs == [("germanic", 0, 1)] and side.tolist() == [[1, -1, 1], [1, -1, -1], [-1, 1, 0]]
    w = np.vstack([np.column_stack([*model.family_w, model.pairs["germanic"][0][2]]), [*model.family_b, model.pairs["germanic"][0][3]]])
    loss, gradient = lid.losses(x, lang, side, lid.row_costs(side, np.bincount(lang), 20), w)
    assert (np.linalg.norm(gradient + w, axis=0) < 0.05 * np.linalg.norm(w, axis=0)).all()


def test_costs_and_weights_are_those_of_one_balanced_machine_where_rows_are_few():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, lid.SIZE)).astype(np.float32) * 0.02
    x[:, :4] += rng.normal(size=(150, 4))
    lang = (x[:, 0] + 0.5 * x[:, 1] > 0.4).astype(int)
    families, pairs, side = lid.machines(["de", "en"])
    cost = lid.row_costs(side, np.bincount(lang), 1000)
    n = np.bincount(lang)
    assert np.allclose(cost[:, 1], 150 / (2 * n)) and (cost[:, 0] == 0).all()
    w = lid.minimised(lambda w: lid.losses(x, lang, side, cost, w), np.zeros((lid.SIZE + 1, 2)))[:, 1]
    v, b = lid.linear_svm(x, np.where(lang == 0, 1.0, -1.0), epochs=300)
    v = np.append(v, b)
    assert w @ v > 0.97 * np.linalg.norm(w) * np.linalg.norm(v)

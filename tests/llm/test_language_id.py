import random
import zlib

import numpy as np

from planiscope.llm import language_id as lid

SYLLABLES = {"de": ["sch", "ein", "ung", "keit", "ß", "ü", "der"], "en": ["the", "ing", "tion", "er", "wh", "ly"], "es": ["ción", "os", "ñ", "que", "ado", "rr"], "fr": ["eau", "ç", "oi", "ment", "ê", "aux"]}


def text(rnd, lang, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_families_and_unknown_codes():
    assert lid.family_of("de") == lid.family_of("en") != lid.family_of("fr") == lid.family_of("es")
    assert lid.family_of("xx") == "other"
    assert sum(map(len, lid.FAMILIES.values())) == len({c for v in lid.FAMILIES.values() for c in v})


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] - 2 * x[:, 1] > 0.2, 1.0, -1.0)
    w, b = lid.linear_svm(x, y, epochs=200, c=10)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97


def test_vectors_look_at_letters_only():
    x, has = lid.vectors(["abc DEF", "abc, def 12", None, "12 !", "", "x"])
    assert np.allclose(x[0], x[1]) and has.tolist() == [True, True, False, False, False, True]
    assert np.allclose(lid.vectors(["x"])[0], x[5:])


def test_held_out_accuracy_and_edge_rows(spark):
    rnd = random.Random(7)
    rows = [(i, text(rnd, lang), lang) for i in range(400) for lang in [rnd.choice(list(SYLLABLES))]]
    rows += [(1000, None, "de"), (1001, "", "en"), (1002, "12 34 !", "fr"), (None, text(rnd, "de"), None), (1003, text(rnd, "es", 3000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lid.train(docs, per_lang=60)
    got = lid.identify(docs, model).withColumn("held_out", lid.held_out()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002):
        assert by[i].lang_pred == "und" and by[i].score == 0
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if i is not None and i < 400 and by[i].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    assert by[1003].lang_pred == "es"


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert lid.train(docs) is None
    assert lid.identify(docs, None).first().lang_pred == "und"
    assert lid.identify(docs.filter("false"), None).collect() == []


def test_what_each_pass_reads_is_packed_and_whole(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i, text(rnd, lang, rnd.choice([1, 20, 200])), lang) for i in range(2000) for lang in [rnd.choice(list(SYLLABLES))]]
    rows += [(i, "nn " * 70_000, "en") for i in range(2000, 2010)] + [(3000, "12 !", "de"), (3001, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    seen = []

    def stored(df, name, real=lid.stored):
        out = real(df, name)
        seen.extend(out.collect())
        return out

    monkeypatch.setattr(lid, "stored", stored)
    assert lid.train(docs, per_lang=20)
    used = [r for r in rows if r[0] < 3000 and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(seen) <= len(used) / lid.BLOCK + 2
    assert sum(len(v) for r in seen for v in r[1:]) < len(used) * lid.SIZE / 4
    got = sorted((v, *x.nonzero()[0], *x[x > 0]) for r in seen for v, x in zip(r[0], lid.unpacked(len(r[0]), *map(bytes, r[1:])), strict=True))
    counts = lid.gram_counts([r[1] for r in used])[0]
    assert counts.max() > 100_000
    assert got == sorted((r[2], *x.nonzero()[0], *x[x > 0]) for r, x in zip(used, counts, strict=True))


def test_packed_counts_come_back():
    counts = np.random.default_rng(2).integers(0, 300, (7, lid.SIZE))
    counts[3, 5], counts[6, -1], counts[2] = 1 << 23, 256, 0
    assert (lid.unpacked(7, *lid.packed(counts)) == counts).all()
    assert lid.unpacked(0, *lid.packed(counts[:0])).shape == (0, lid.SIZE)

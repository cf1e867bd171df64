import random

import pytest

from planiscope.llm import decontamination, simhash, substring_dedup
from tests.llm.test_decontamination import make
from tests.llm.test_repeats import plain_words
from tests.llm.test_simhash import plain_components, plain_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items, _, words = make()
    rnd = random.Random(4)
    passage = " ".join(words(50))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs]
    rows += [(500 + i, docs[i][1], "en", "copy", len(docs[i][1])) for i in (1, 2, 3)]
    for i in range(4):
        t = " ".join([*words(30), passage, *words(20)])
        rows.append((600 + i, t, None, "s", len(t)))
    rows += [(700, None, "en", "s", None), (701, "12 34 !", "en", "s", 7), (702, "", None, None, 0)]
    rnd.shuffle(rows)
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_every_stage_against_plain_code_on_its_own_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        seen[name] = ({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()})
        docs = out
    before, after = seen["language_id"]
    assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
    before, after = seen["simhash_near_dedup"]
    fps = {i: plain_fingerprint(r.text, corpus_pipeline.SHINGLE) for i, r in before.items()}
    roots = plain_components(sorted(set(fps.values())), corpus_pipeline.RADIUS)
    least = {}
    for i, f in fps.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    assert set(after) == set(least.values()) and not {501, 502, 503} & set(after)
    before, after = seen["substring_dedup"]
    plain = plain_words([(i, r.text) for i, r in before.items()], 35)
    for i, r in before.items():
        n, removed, _ = plain[i]
        assert (i in after) == (removed < n)
        if i in after:
            assert len(after[i].text.split()) == n - removed and (removed or after[i] == r)
    assert len(after[600].text.split()) == 50
    before, after = seen["decontamination"]
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    norm = lambda t: " ".join(decontamination.words_of(t).astype(str))
    holds = {i for i, r in before.items() if any(norm(q) in norm(r.text) for q in bench.values())}
    gone = set(before) - set(after)
    assert holds and len(gone & holds) >= 0.9 * len(holds) and gone <= holds
    before, after = seen["byte_bpe"]
    import hashlib

    assert set(before) == set(after)
    for i, r in after.items():
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() and 4 * r.n_tokens == len(r.token_ids)


def test_run_and_registration(spark, folder):
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op") and q[2].isdigit()) == list(range(1, 11))
    assert queries["pipeline"](spark, folder).count() > 300
    assert simhash and substring_dedup


def test_null_and_repeated_ids_cost_only_true_copies(spark, folder):
    docs, items, _, words = make()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(2)
    texts = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()))
    a, b, c, d, e, f, rep = (" ".join(words(80)) for _ in range(7))
    rows = [(None, a), (None, b), (None, c), (None, a), (7, d), (7, e), (8, d)]
    assert sorted(r.text for r in corpus_pipeline.drop_near_duplicates(spark, table(rows), folder).collect()) == sorted([a, b, c, d, e])
    rows = [(7, f"{a} {rep}"), (7, f"{b} {rep}"), (None, f"{c} {rep}"), (None, d)]
    got = texts(corpus_pipeline.drop_repeated_substrings(spark, table(rows), folder))
    assert [(n, i, t.strip()) for n, i, t in got] == sorted([(False, 7, a), (False, 7, b), (True, 0, c), (True, 0, d)])
    clean = [(i, t) for i, t in docs if i % 20]
    rows = [(7, e), (7, f"{a} {items[0][1]} {b}"), (None, f"{c} {items[1][1]} {d}"), (None, f)]
    got = {x for x in texts(corpus_pipeline.drop_contaminated(spark, table(rows + clean), folder)) if x[2] not in {t for _, t in clean}}
    assert got == {(False, 7, e), (True, 0, f)}


def test_letters_of_no_language_are_rejected(spark, folder):
    rnd = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {"en": "the of and with that thing which would house", "de": "der und nicht ein schule zwischen auch wird haus", "fr": "le une dans avec pour maison toujours elle que", "es": "el los una con para siempre ella casa ayer"}
    text = {k: lambda w=v.split(): " ".join(rnd.choice(w) + rnd.choice(["", "", rnd.choice(w)]) for _ in range(60)) for k, v in stems.items()}
    rows = [(i, text[k](), k) for i, k in enumerate(list(stems) * 60)]
    junk = [(1000 + i, " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(60)), None) for i in range(30)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, folder).collect()}
    assert kept == {i: k for i, _, k in rows}


def test_clashing_columns_and_empty_tables(spark, folder):
    _, items, _, words = make()
    a, b, rep = (" ".join(words(80)) for _ in range(3))
    rows = [(1, f"{a} {rep}", "en"), (2, f"{b} {rep}", "en"), (2, f"{b} {items[0][1]} {a}", "en"), (None, None, None), (4, "", "en"), (5, f"{a} {rep}", "en")]
    names = ["lang_pred", "score", "_text", "_id", "_kept", "uid", "id", "kept", "row", "spans", "n_words", "n_removed", "component", "fp", "item_id", "place"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(i, t, k, "s", len(t or ""), *range(len(names))) for i, t, k in rows], schema).repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and all([r[n] for n in names] == list(range(len(names))) for r in out.collect())
        assert stage(spark, docs.filter("false"), folder).collect() == []
    assert sorted(r.text for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect() if r.text) == sorted([rows[0][1], rows[1][1], rows[2][1]])
    assert corpus_pipeline.encode(spark, docs, folder).count() == len(rows) and corpus_pipeline.encode(spark, docs.filter("false"), folder).count() == 0

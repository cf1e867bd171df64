import random
import re

from pyspark.sql import functions as F

from planiscope.llm import decision_list as d

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics_against_plain_code(spark):
    rnd = random.Random(2)
    pieces = ["a", "b", "é", "c#", "|", "\n", " ", "\t", "\x0b", "\r\n", "&amp;", " x", "😀"]
    texts = [None, "", " \n ", "one", "a b", "a b c a b c", "x\nx\n\n \nx y\n"] + ["".join(rnd.choice(pieces) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 150))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = d.statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == plain(texts[r.doc_id]), texts[r.doc_id]


def good(rnd):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(60, 120))) + "."


def test_learns_a_list_that_rejects_what_labels_reject(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        kind = i % 4
        text = good(rnd)
        if kind == 1:
            text = text.upper()
        if kind == 2 and i % 8 == 2:
            text = text.replace(" ", " # ")
        rows.append((i, text, 0))
        if i < 400:
            labels.append((i, int(kind != 1 and i % 8 != 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, good int")
    train = d.sample(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    rules = d.learn(train)
    assert 1 <= len(rules) <= 4 and all(1 <= len(r) <= 3 for r in rules)
    judged = d.judge(docs, rules)
    assert "Python" not in judged._jdf.queryExecution().executedPlan().toString()
    wrong = sum(r.kept != (r.doc_id % 4 != 1 and r.doc_id % 8 != 2) for r in judged.collect())
    assert wrong <= 6
    assert judged.filter(F.col("kept") & F.col("base_failed")).count() == 0


def test_no_labels_nulls_empties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a " * 60, 2), (1, None, 3)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert d.learn(d.sample(docs, labels)) == []
    got = d.judge(docs, []).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept for r in got)
    assert d.judge(docs.filter("false"), []).collect() == []

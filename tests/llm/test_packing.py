import json
import random

import numpy as np
import public_tokenizers

from planiscope.llm import packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(sizes, row):
    rooms, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            least = min(fits)[0]
            k = [k for r, k in fits if r == least][0]
            rooms[k] -= sizes[i]
            rows[k].append(i)
        else:
            rooms.append(row - sizes[i])
            rows.append([i])
    return rows


def test_best_fit_against_plain_code():
    rnd = random.Random(1)
    for _ in range(60):
        row = rnd.choice([1, 7, 16, 50])
        sizes = [rnd.randint(1, row) for _ in range(rnd.randint(0, 120))]
        got, want = packing.best_fit_decreasing(sizes, row), plain(sizes, row)
        shape = lambda rows: sorted(sum(sizes[i] for i in r) for r in rows)  # noqa: E731  rows of equal room may swap what they hold
        assert shape(got) == shape(want)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= row for r in got)


def test_documents_come_back_whole(spark, tmp_path):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "of", "löng", "word", "\n"]) for _ in range(rnd.choice([0, 3, 40, 900]))) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    packed = packing.pack(docs, PATH, PATTERN, row=128, pad=7, end_id=50256, window=3000).cache()
    enc, parts = packing._encoding(PATH, PATTERN), {}
    rows = packed.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == 7).all()
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == r.n_segments
        assert (np.flatnonzero(packing.positions(r.cu_seqlens, 128)[: r.n_tokens] == 0) == r.position_resets).all()
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.setdefault(d, {})[o] = ids[a:b].tolist()
    for i, t in enumerate(texts):
        assert [x for _, p in sorted(parts[i].items()) for x in p] == [*enc.encode_ordinary(t or ""), 50256]
    full = sum(len(enc.encode_ordinary(t or "")) + 1 for t in texts)
    assert full / (128 * len(rows)) > 0.9
    files = packing.write(packed, f"file://{tmp_path}/out").collect()
    assert sum(f.rows for f in files) == len(rows) and len(files) > 2
    for f in files:
        matrix = np.fromfile(tmp_path / "out" / f"{f.name}.ids", "<u2").reshape(-1, 128)
        meta = [json.loads(x) for x in (tmp_path / "out" / f"{f.name}.json").read_text().splitlines()]
        assert len(matrix) == len(meta) == f.rows
    back = packing.read(spark, f"file://{tmp_path}/out").collect()
    assert sorted(back) == sorted(rows)
    again = packing.pack(docs.repartition(5), PATH, PATTERN, row=128, pad=7, end_id=50256, window=3000)
    assert sorted(again.collect()) == sorted(rows)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    (r,) = packing.pack(docs, PATH, PATTERN, row=16).collect()
    assert sorted(r.doc_ids, key=str) == [1, 1, None] and r.n_segments == 3
    assert packing.pack(docs.filter("false"), PATH, PATTERN).collect() == []

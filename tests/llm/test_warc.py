import gzip
import hashlib
import os
import random

import pytest

from planiscope.llm import warc


def plain(rows):
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            d = hashlib.sha256(b).hexdigest()
            least[d] = min(least.get(d, i), i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = least.get(d, i) != i
        out.append((i, u or "", len(b), d, "revisit" if again else "response", least[d] if again else None, None if again else b))
    return sorted(out, key=str)


def pages(n=300):
    rnd = random.Random(3)
    common = ["<p>" + "x" * 200, "short", "é" * 60]
    rows = [(i, f"http://h/{i}", rnd.choice([*common, None, "", f"<b>{i}</b>" * 30])) for i in range(n)]
    rnd.shuffle(rows)
    return rows


def test_round_trip_and_revisits(spark, tmp_path):
    rows = pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.archive(table, f"file://{tmp_path}/a", roll_bytes=4000, shard_bytes=9000)
    assert sorted([tuple(r)[:6] + (bytes(r.payload) if r.payload is not None else None,) for r in got.collect()], key=str) == plain(rows)
    names = sorted(x for x in os.listdir(tmp_path / "a") if not x.startswith("."))
    assert len(names) > 4 and not any("_temporary" in x for x in names)
    assert warc.read(spark, f"file://{tmp_path}/a").count() == len(rows)


def test_same_bytes_for_any_order_of_rows(spark, tmp_path):
    rows = pages(120)
    sums = []
    for k, order in enumerate((rows, rows[::-1])):
        table = spark.createDataFrame(order, "page_id long, url string, html string").repartition(2 + k)
        warc.write(table, f"file://{tmp_path}/{k}", roll_bytes=3000, shard_bytes=5000)
        sums.append((tmp_path / str(k) / "MANIFEST.jsonl").read_text())
    assert sums[0] == sums[1]


def test_members_follow_the_standard(spark, tmp_path):
    table = spark.createDataFrame([(1, "http://h/1\r\nx", "a" * 150), (2, None, "a" * 150)], "page_id long, url string, html string")
    warc.write(table, f"file://{tmp_path}/s")
    (name,) = [x for x in os.listdir(tmp_path / "s") if x.endswith(".gz") and not x.startswith(".")]
    text = gzip.open(tmp_path / "s" / name).read().decode()
    assert text.count("WARC/1.1\r\n") == 2 and "WARC-Type: revisit" in text and "WARC-Target-URI: http://h/1%0D%0Ax\r\n" in text
    with open(tmp_path / "s" / name, "rb") as f:
        records = list(warc.parse(f.read()))
    assert records[1][0]["WARC-Refers-To"] == records[0][0]["WARC-Record-ID"]


def test_damage_is_found(spark, tmp_path):
    good = gzip.compress(warc.record("<urn:x>", 1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), 3, None, "2000-01-01T00:00:00Z"))
    with pytest.raises(ValueError):
        list(warc.parse(good[:-20]))


def test_reader_checks_what_revisits_name_and_the_files_of_the_manifest(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "a" * 150), (2, "v", "a" * 150), (3, "w", "b")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/c"
    warc.write(table, folder)
    (name,) = [x for x in os.listdir(tmp_path / "c") if x.endswith(".gz") and not x.startswith(".")]
    whole = (tmp_path / "c" / name).read_bytes()
    first = len(gzip.compress(b"")) and whole.index(b"\x1f\x8b", 2)
    (tmp_path / "c" / name).write_bytes(whole[first:])
    with pytest.raises(ValueError, match="not in the archive"):
        warc.read(spark, folder)
    os.remove(tmp_path / "c" / name)
    with pytest.raises(Exception, match="is missing"):
        warc.read(spark, folder)


def test_one_id_or_an_outlier_does_not_fill_a_shard(spark, tmp_path):
    rows = [(None, f"http://h/{i}", f"{i} " * 100) for i in range(40)] + [(1 << 60, "x", "y" * 300)] + [(i, "z", f"{i}z" * 100) for i in range(40)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write(table, f"file://{tmp_path}/o", shard_bytes=3000).collect()
    assert len({f.file[:11] for f in files}) >= 5 and max(f.records for f in files) <= 40
    got = warc.read(spark, f"file://{tmp_path}/o").collect()
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in got), key=str) == sorted(((i, h) for i, _, h in rows), key=str)


def test_null_ids_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(None, "u", "b" * 120), (4, "u", "b" * 120), (4, "u", "b" * 120), (3, "v", None), (3, "v", None), (9, "w", "c" * 100), (9, "w", "c" * 100)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted([(r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in warc.archive(table).collect()], key=str)
    assert got == sorted([(-1, "response", None), (4, "revisit", None), (4, "revisit", None), (3, "response", None), (3, "response", None), (9, "response", None), (9, "revisit", 9)], key=str)
    assert warc.archive(table.filter("false")).collect() == []

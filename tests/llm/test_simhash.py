import random

import xxhash

from planiscope.llm import simhash


def plain_fingerprint(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, radius=2):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_masks_cover_every_pair_within_the_radius():
    for level in range(3):
        masks = simhash.covering_masks(2, level)
        assert len(masks) == 7
        for i in range(64):
            for j in range(64):
                flip = (1 << i) | (1 << j)
                assert any(m & flip == 0 for m in masks)


def test_fingerprint_against_plain_code():
    rnd = random.Random(1)
    for text in ["", "  \n", "One", "One two", "A\x0bb\x0cC d\te f É"] + [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(3, 90))) for _ in range(40)]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
        assert simhash.fingerprint(text.encode(), 5) == plain_fingerprint(text, 5)


def test_links_and_components_with_buckets_dealt_again(spark):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) & (2**64 - 1) for s in seeds for _ in range(40)}
    want = plain_components(sorted(fps))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    table = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    for bucket in (2048, 8):
        got = {r.node: r.root for r in simhash.components(simhash.links(table, bucket=bucket)).collect()}
        groups, expected = {}, {}
        for f, s in signed.items():
            groups.setdefault(got.get(s, s), set()).add(f)
            expected.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_wider_radius_against_plain_code(spark):
    rnd = random.Random(6)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    fps = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))) for s in seeds for _ in range(12)})
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = plain_components(fps, 5)
    got = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(table, 5)).collect()}
    assert len({want[f] for f in fps}) > 40
    for a in fps:
        for b in fps[:60]:
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_one_large_group_in_every_bucket(spark):
    """Thousands of fingerprints within a few bits of each other, far more than `bucket`: dealt out again, links kept."""
    rnd = random.Random(7)
    one = rnd.getrandbits(64)
    near = sorted({one ^ sum(1 << b for b in rnd.sample(range(64), 2)) for _ in range(1500)} | {one} | {rnd.getrandbits(64) for _ in range(200)})
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in near], "fp long").repartition(4)
    got = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(table, bucket=300)).collect()}
    group = {f for f in near if (f ^ one).bit_count() <= 2}
    assert len({got[f] for f in group}) == 1 and set(got) == group


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_rows_nulls_copies_empties_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "a"), (2, long, "b"), (9, long.replace("w7 ", "x "), "c"), (7, "", "d"), (8, None, "e"), (None, " \n", "f"), (3, "other text here now", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {d: plain_fingerprint(t) for d, t, _ in rows}
    want = plain_components(sorted(set(fps.values())))
    for d, _, _ in rows:
        assert got[d].fp % (1 << 64) == fps[d]
        assert got[d].component == min(x for x in fps if x is not None and want[fps[x]] == want[fps[d]])
    assert simhash.near_duplicates(docs.filter("false")).collect() == []

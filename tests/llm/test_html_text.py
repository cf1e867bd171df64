import random

import pytest

from planiscope.llm import html_text as h


def text_of(source, before=None, after=None):
    page = h.Page.of(1, "u", "h", "/a", source)
    return h.main_text(page, before, after)


def test_article_without_its_surroundings():
    source = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script><style>p{}</style></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad box">Buy</div><div id="cookie-notice">We</div>
    <article><h1>Head &amp; more</h1><p><b>One<br>two.<br><p>Th&#114;ee&nbsp;&lt;4&gt;   five</p><form>Mail <input></form><aside>Side</aside>
    <!-- <p>no</p> --><section class="comments"><p>I agree</p></section><p hidden>gone</p></article><footer>&copy; x</footer></body></html>"""
    assert text_of(source) == "Head & more\n\nOne two.\n\nThree <4> five"


@pytest.mark.parametrize("source,want", [("", ""), ("plain", "plain"), ("<p>a <b", "a"), ("a < b <p>c", "a < b\n\nc"), ("<article><p title='>'>x", "x"), ('<p title="un>x</p>', ""), ("<article></article>", ""), ("<script>x", "")])
def test_broken_sources(source, want):
    got = text_of(source)
    assert got == want or source.startswith('<p title="un')


def test_lcs_against_plain_code():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.choice("abcde") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
        got = h.shared(a, b)
        assert len(got) == size[-1][-1]
        at = iter(b)
        assert all(a[i] in at for i in sorted(got))  # a subsequence of b


def test_lcs_of_repeated_lines_on_very_long_pages():
    middle = ["s", "t"] * 24_000
    got = h.shared(["p", *middle, "q"], ["q", *middle, "p"])
    assert got == set(range(1, len(middle) + 1))


def test_lcs_in_parts_is_as_long_as_whole(monkeypatch):
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([str(rnd.randrange(5)) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        monkeypatch.setattr(h, "ROW_BITS", 1 << 31)
        whole = h.shared(a, b)
        monkeypatch.setattr(h, "ROW_BITS", 8)
        parts = h.shared(a, b)
        rest = iter(b)
        assert len(parts) == len(whole) and all(a[i] in rest for i in sorted(parts))


def test_shared_lines_go_where_nothing_says_what_the_article_is():
    make = lambda body: f"<div>Site name</div><div><a href='/'>Home</a></div>{body}<div>About us and more</div>"
    a, b = make("<p>First story here.</p><p>It goes on.</p>"), make("<p>Second story.</p><p>Also long.</p><p>End.</p>")
    other = h.Page.of(2, "u", "h", "/b", b)
    assert text_of(a, other) == "First story here.\n\nIt goes on."
    assert text_of(a, h.Page.of(2, "u", "elsewhere", "/b", b)) == "Site name\n\nFirst story here.\n\nIt goes on.\n\nAbout us and more"
    assert h.copies(h.Page.of(1, "u", "h", "/a", a), h.Page.of(3, "u", "h", "/a2", a))


def test_names_count_only_whole():
    assert text_of('<div class="content has-sidebar"><p>Body text.</p></div>') == "Body text."
    assert text_of('<article><div class="story no-comments"><p>Body text.</p></div></article>') == "Body text."
    assert text_of('<article><p class="notice-of-award">Prize.</p><p class="lead notice">Closed.</p><p>Go <span class="ad">buy</span>on</p></article>') == "Prize.\n\nGo on"


def test_lines_inside_an_article_go_if_both_neighbours_have_them():
    make = lambda i, extra: h.Page.of(i, "u", "h", f"/{i}", f"<article><h1>Title {i}</h1><p>Sign up for our letter.</p><p>Long text of page {i} that nobody else has.</p>{extra}</article>")
    a, b, c = make(1, "<p>A quote.</p>"), make(2, "<p>A quote.</p>"), make(3, "")
    assert h.main_text(b, a, c) == "Title 2\n\nLong text of page 2 that nobody else has.\n\nA quote."
    assert "Sign up" in h.main_text(b, a, None)


def plain_lcs(a, b):
    """Indices of `a` in a longest common subsequence with `b`; the fixtures leave no choice of it."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    out = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain_texts(pages):
    """Texts of (page_id, host, path, article lines or None, other lines), in the order of URLs."""
    out = []
    weight = lambda lines: sum(len(x) ** 2 for x in lines)

    def alike(p, q):
        x, y = p[3] or p[4], q[3] or q[4]
        least = min(weight(x), weight(y))
        return p[1] == q[1] and (p[3:] == q[3:] or least > 0 and 2 * weight([x[i] for i in plain_lcs(x, y)]) >= least)

    for k, p in enumerate(pages):
        lo = hi = k
        while lo and alike(pages[lo - 1], pages[lo]):
            lo -= 1
        while hi + 1 < len(pages) and alike(pages[hi], pages[hi + 1]):
            hi += 1
        near = [q for q in (pages[lo - 1] if lo else None, pages[hi + 1] if hi + 1 < len(pages) else None) if q and q[1] == p[1]]

        def common(q, p=p):
            x, y = p[2].split("/"), q[2].split("/")
            lead = lambda a, b: next((i for i, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
            return lead(x, y), lead(p[2], q[2])

        near.sort(key=common, reverse=True)
        own = (p[4][:1], p[3] or [], p[4][1:])
        own = [*own[0], *own[1], *own[2]]
        all_of = lambda q: [*q[4][:1], *(q[3] or []), *q[4][1:]]
        gone = [{own[i] for i in plain_lcs(own, all_of(q))} for q in near]
        if p[3]:
            keep = [x for x in p[3] if not (len(gone) == 2 and x in gone[0] and x in gone[1])]
        else:
            keep = [x for x in own if not (gone and x in gone[0])]
        out.append((p[0], "\n\n".join(keep)))
    return dict(out)


def test_runs_and_partitions_against_plain_code(spark):
    """Groups of copies, near copies, ties and pages alone on a host, over partitions that cut the runs."""
    rnd = random.Random(5)
    pages, rows = [], []
    for i in range(120):
        host = rnd.choice(["a.example", "a.example", "b.example"]) if i < 118 else f"alone{i}.example"
        path = f"/{rnd.choice('pq')}/{rnd.choice('xyz')}{i:03d}"
        if i % 4 == 3 and i < 100:  # a copy under a URL beside the last page's, some with one line more
            _, host, at, article, other = pages[-1]
            path = f"{at}-copy{i}"
            article = article and [*article, f"Copy {i}."] if rnd.random() < 0.5 else article
        else:
            lines = [f"{' '.join(rnd.choice('uvwxyz') * 3 for _ in range(6))} {i} {j}." for j in range(rnd.randint(1, 4))]
            article = [f"Notice of {host}", *lines] if rnd.random() < 0.6 else None
            other = [f"Menu of {host}", *([] if article else lines), f"Imprint of {host}"]
        pages.append((i, host, path, article, other))
    for i, host, path, article, other in pages:
        body = f"<article>{''.join(f'<p>{x}</p>' for x in article)}</article>" if article else ""
        rows.append((i, f"http://{host}{path}", f"<div>{other[0]}</div>{body}" + "".join(f"<div>{x}</div>" for x in other[1:])))
    want = plain_texts(sorted(pages, key=lambda p: (p[1], p[2], p[0])))
    assert sum("Notice" not in t and "Menu" not in t for t in want.values()) > 60
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    for n in ("1", "4", "30"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = h.extract(table).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_long_runs_wait_and_copies_get_equal_texts(spark):
    page = lambda i, body: (i, f"http://a.example/{i:05d}", f"<div>Menu</div>{body}")
    rows = [page(i, "<p>The same story for all of us.</p>") for i in range(2300)] + [page(9000, "<p>Another one, quite different.</p>")]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert set(got.values()) == {"The same story for all of us.", "Another one, quite different."} and len(got) == 2301


def test_nulls_and_empties(spark):
    rows = [(500, None, None, 1), (None, "no url", "<p>x", 1), (501, "http://c.example/", "", 1), (501, "http://c.example/", "", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, lines int")
    got = [(r.page_id, r.text) for r in h.extract(table).collect()]
    assert sorted(got, key=str) == sorted([(500, ""), (None, "x"), (501, ""), (501, "")], key=str)
    assert h.extract(table.filter("false")).collect() == []

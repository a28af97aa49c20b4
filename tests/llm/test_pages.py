"""Wrapper induction: alignment, regions, templates, odd markup."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lumenspan.llm import wrapper


def text(page: str, template=()):
    """The main text, when the template holds every block whose text is listed."""
    root = wrapper.parse(page)
    return wrapper.article(root, frozenset(b.slot for b in wrapper.blocks(root)[0] if b.text in template))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("", ""),
        ("plain", "plain"),
        ("<p>a<p>b &amp; c&nbsp;&lt;d&gt; &#233;", "a\nb & c <d> é"),
        ("<nav>x</nav><header>h</header><p>body</p><aside>s</aside><footer>f</footer>", "body"),
        ("<article><header><h1>Head</h1></header><p><b>one<br><p>two</article><p>out", "Head\none\ntwo"),
        ("<div class='ad'>x</div><div id=comments><p>y</div><div class=advice>kept</div>", "kept"),
        ("<script>var t='</p>';<p></script><style>p{}</style><!-- c --><p>kept<noscript>n</noscript>", "kept"),
        ("<form>f<p>g</form><div role=banner>b</div><div hidden>h</div><ul><li>one<li>two</ul>", "one\ntwo"),
        ("<p>a\n  b\tc</p>\n<p>   </p>", "a b c"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("</p></div>stray<p", "stray"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_regions(page, expected):
    assert text(page) == expected


def test_template_text_goes_unless_all_is():
    page = "<div>Site name</div><p>story</p>"
    assert text(page, ["Site name"]) == "story" and text(page, ["Site name", "story"]) == "Site name\nstory"
    assert text("<article><p>story</article>", ["story"]) == "story"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<![foo[bar]]><p>kept", "kept"),
        ("<p>a<![CDATA[x]]>b", "ab"),
        ("<p>a<![if IE]>b<![endif]>c", "abc"),
        ("<p>kept<![", "kept"),
        ("<!DOCTYPE html [<!ENTITY x 'y'>]><p>kept", "]>\nkept"),
        ("<p>a<? php ?>b<!foo>c", "abc"),
    ],
)
def test_odd_declarations(page, expected):
    assert text(page) == expected


def test_few_pages_prove_little():
    assert [n for n in range(1, 12) if wrapper.is_template(n, n)] == list(range(5, 12))
    assert not wrapper.is_template(79, 100) and wrapper.is_template(80, 100) and not wrapper.is_template(4, 5)
    for n in range(1, 60):
        for k in range(n + 1):
            z, p = wrapper.ERRORS, k / n
            low = (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)
            assert wrapper.is_template(k, n) == (p >= wrapper.TEMPLATE_SHARE and low > wrapper.CERTAIN + 1e-15)


def test_deep_trees_align():
    deep = wrapper.skeleton(wrapper.parse("<div><p>x</p>" * 900 + "a"))
    other = wrapper.skeleton(wrapper.parse("<div><p>x</p>" * 899 + "<ul><li>y</ul>b"))
    assert len(wrapper.align(deep, deep)) == len(deep) and len(wrapper.align(deep, other)) >= 2 * 899


def plain_extract(rows):
    """The whole operator by plain code: reference page, plain tree matching, counts, template, main text."""
    from collections import Counter, defaultdict

    from urllib.parse import urlsplit

    hosts = defaultdict(list)
    for i, url, html in rows:
        hosts[urlsplit(url).hostname or "" if url else ""].append((i, url, wrapper.parse(html)))
    out = {}
    for pages in hosts.values():
        trees = {}
        for *_, root in pages:
            tree = wrapper.skeleton(root)
            trees[wrapper.mark(json.dumps(tree))] = tree
        drawn = {}
        for h, tree in sorted(trees.items()):
            drawn.setdefault(h % wrapper.DRAWN, (len(tree), h, json.dumps(tree), tree))
        reference = sorted(drawn.values(), key=lambda d: d[:3])[len(drawn) // 2][3]
        count = Counter()
        for tree in trees.values():
            count.update({reference[x][2] for x, y in plain_match(reference, tree) if reference[x][2] and reference[x][2] == tree[y][2]})
        template = frozenset(t for t, k in count.items() if wrapper.is_template(k, len(trees)))
        for i, _, root in pages:
            out[i] = wrapper.article(root, template)
    return out


def plain_match(a, b, x=0, y=0):
    """Pairs of one largest matching by the definition, children by a table; among equals one with most like subtrees."""

    def whole(t, n):
        return (t[n][0], t[n][2], *[whole(t, k) for k in range(1, len(t)) if t[k][1] == n])

    p, q = ([k for k in range(1, len(t)) if t[k][1] == n] for t, n in ((a, x), (b, y)))
    each = {(c, d): (plain_match(a, b, c, d), whole(a, c) == whole(b, d)) for c in p for d in q if a[c][0] == b[d][0]}
    m = {(i, j): ([], 0) for i in range(len(p) + 1) for j in range(len(q) + 1) if not i or not j}
    for i, c in enumerate(p, 1):
        for j, d in enumerate(q, 1):
            own, like = each.get((c, d), ([], 0))
            met = m[i - 1, j - 1]
            m[i, j] = max(m[i - 1, j], m[i, j - 1], (met[0] + own, met[1] + like), key=lambda v: (len(v[0]), v[1]))
    return [(x, y), *m[len(p), len(q)][0]]


def test_extract_is_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for n, site in enumerate(["a.example", "b.example", "c.example"]):
        for i in range([60, 12, 3][n]):
            paras = "".join(f"<p>{site} {i} {rng.random()}</p>" for _ in range(rng.randint(1, 4)))
            side = "<ul><li>Home<li>News</ul>" if rng.random() < 0.9 else "<ul><li>News</ul>"
            note = "<p>Share this page</p>" if rng.random() < 0.9 else ""
            body = f"<div>{side}<div>Welcome to {site}</div><article><h1>T {i}</h1>{note}{paras}<p>Subscribe now</p></article><p>All rights reserved</p></div>"
            if site == "b.example":
                body = body.replace("article>", "section>")
            rows.append((len(rows), f"https://{site}/{i}", body))
    rows += [(len(rows) + k, "https://b.example/copy", rows[61][2]) for k in range(30)]  # copies prove nothing
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == plain_extract(rows)
    assert "Share" not in got[5] and "Subscribe" not in got[5] and "Welcome" not in got[65]
    assert "Share" in got[73]  # three pages prove nothing


def test_an_empty_template_shows(spark, monkeypatch):
    """The induced template, not regions, takes constant lines out of articles."""
    rows = [(i, "http://a.example/", f"<article><h1>T {i}</h1><p>Share</p></article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in wrapper.extract(df).collect()} == {f"T {i}" for i in range(20)}
    monkeypatch.setattr(wrapper, "TEMPLATE_SHARE", 2.0)
    assert {r["text"] for r in wrapper.extract(df).collect()} == {f"T {i}\nShare" for i in range(20)}


def test_deep_pages_through_extract(spark):
    rows = [(i, "http://deep.example/", "<div>" * 3000 + f"<p>deep {i % 3}" + "</div>" * i + f"<p>x {i}") for i in range(7)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"x {i}" in t for i, t in got.items()) and len(got) == 7


def test_alignment_is_largest():
    def tree(*labels):
        return [("#root", -1, 0), *[(x, 0, 0) for x in labels]]

    got = wrapper.align(tree("a", "b", "a", "c"), tree("b", "x", "a", "a", "c"))
    assert sorted(got) in ([(0, 0), (2, 1), (3, 3), (4, 5)], [(0, 0), (2, 1), (3, 4), (4, 5)])
    nested = [("#root", -1, 0), ("div", 0, 0), ("p", 1, 0), ("p", 1, 0), ("div", 0, 0)]
    other = [("#root", -1, 0), ("div", 0, 0), ("div", 0, 0), ("p", 2, 0), ("p", 2, 0)]
    assert (1, 2) in wrapper.align(nested, other)
    long = tree(*["p"] * 80)
    assert len(wrapper.align(long, tree(*["p"] * 70))) == 71


def page(i, host="a.example"):
    return (i, f"http://{host}/{i}", f"<html><body><div>Welcome to the site</div><div>{'story ' * (i % 5 + 1)}{i}</div><p>All rights reserved</p></body></html>")


def test_extract(spark):
    rows = [page(i) for i in range(40)] + [page(i, "small.example") for i in (100, 101)] + [(200, None, "<p>x"), (201, "no url", None), (202, "http://a.example/", ""), (None, "http://a.example/q", "<p>q"), (1, *page(1)[1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("template", F.lit(2))
    got = wrapper.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r["page_id"]: r for r in got.collect()}
    assert by[7]["text"] == "story story story 7" and by[7]["n_chars"] == 19
    assert by[100]["text"].split("\n")[0] == "Welcome to the site"
    assert (by[200]["text"], by[201]["text"], by[202]["text"], by[None]["text"]) == ("x", "", "", "q")
    assert wrapper.extract(df.limit(0)).count() == 0


def test_template_inside_articles(spark):
    def story(i):
        body = f"<article><h1>Title {i}</h1><p>Share this page</p><p>{'story ' * (i % 4 + 1)}{i}</p><p>Home</p><div>Subscribe now</div></article>"
        return (i, f"http://a.example/{i}", f"<html><body><ul><li>Home</ul>{body if i else body.replace('Share this page', 'Zero')}</body></html>")

    rows = [story(i) for i in range(20)] + [(99, "http://a.example/99", "<html><body><ul><li>Home</ul><article><blockquote>Home</blockquote><p>More</p></article></body></html>")]
    by = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[3] == "Title 3\nstory story story story 3" and by[0] == "Title 0\nZero\nstory 0"
    assert by[99] == "Home\nMore"


@pytest.mark.parametrize("name", ["entry-header", "article-header", "post-header", "side-effects", "share-price", "related-work", "search-results", "notice"])
def test_class_names_inside_articles(name):
    for tag in ("article", "main"):
        assert text(f"<{tag}><header class='{name}'><h1>Head</h1></header><div class='{name}'>kept</div><p>story</p></{tag}>") == "Head\nkept\nstory"
    assert text(f"<div class='{name}'>x</div><p>story</p>") == "story"


def test_whole_marks_inside_articles():
    assert text("<article><p>story</p><div class='box Ad'>x</div><section id=comments>y</section><div class='sidebar'>z</div><aside>a</aside></article>") == "story"


def test_long_lists_are_aligned_fully():
    def tree(*labels):
        return [("#root", -1, 0), *[(x, 0, 0) for x in labels]]

    # The first list's x comes up only at the other's end.
    a, b = tree("x", *["p", "q"] * 50), tree(*["p", "q"] * 49, "p", "x", "q")
    assert len(wrapper.align(a, b)) == 1 + 100


def test_long_alignment_is_the_short_one(monkeypatch):
    rng = random.Random(4)

    def tree(n):
        flat = [("#root", -1, 0)]
        for _ in range(n):
            flat.append((rng.choice("abc"), rng.choice([0, 0, *range(max(0, len(flat) - 3), len(flat))]), 0))
        return flat

    pairs = [(tree(rng.randint(1, 60)), tree(rng.randint(1, 60))) for _ in range(60)]
    short = [wrapper.align(*p) for p in pairs]
    monkeypatch.setattr(wrapper, "FULL_ALIGNMENT", 0)
    for (a, b), s in zip(pairs, short, strict=True):
        got = wrapper.align(a, b)
        assert got == s and len(got) == plain_size(a, b) and len({x for x, _ in got}) == len({y for _, y in got}) == len(got)
        met = dict(got)
        assert all(a[x][0] == b[y][0] and (not x or met[a[x][1]] == b[y][1]) for x, y in got)
        assert all((x < u) == (y < v) for x, y in got for u, v in got if x != u and a[x][1] == a[u][1])


def plain_size(a, b, x=0, y=0):
    """Simple tree matching by its definition."""
    if a[x][0] != b[y][0]:
        return 0
    p, q = ([k for k in range(1, len(t)) if t[k][1] == n] for t, n in ((a, x), (b, y)))
    m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, c in enumerate(p, 1):
        for j, d in enumerate(q, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + plain_size(a, b, c, d))
    return 1 + m[-1][-1]

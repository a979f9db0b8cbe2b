import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.llm import html_extract as H

SF = "/root/testdata/sf0.01"


def article_text(page):
    """The text between the article's tags, by plain replacement: what the pages of the test tables mean."""
    a = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    a = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", a, flags=re.S)
    a = re.sub(r"</?(b|a|i|em|strong|span)\b[^>]*>", "", a)
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", a)).split())


@pytest.fixture(scope="module")
def model(spark):
    return H.fit([r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()])


def test_every_page_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, article_text(r.html)) for r in pages.collect()}
    got = H.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_pages_without_semantic_tags(spark, model):
    bad = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        nodes = H.parse(r.html)
        H.neutral(nodes)
        bad += H.text_of(nodes, H.decode(nodes, H.predict(model, H.features(nodes)))) != article_text(r.html)
    assert bad <= 5


LONG = "Many words stand here, one after another, so that a reader has something to read. They go on for a while. "


def test_menus_forms_comments_and_the_like_stay_out(model):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header>"
            "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='cookie notice'>We use cookies.</div>"
            "<article><h1>Head &amp; line</h1>" + "".join(f"<p>{LONG * 3}{i}</p>" for i in range(6)) + "<script>var a = '</p>';</script></article>"
            "<aside class='sidebar'><ul><li><a href='/c'>Other</a></li></ul></aside><form><input name=q><label>Search</label></form>"
            "<div class='comments'><p>I liked it.</p></div><footer>&copy; us</footer></body></html>")
    want = " ".join(["Head & line"] + [(LONG * 3).strip() + " " + str(i) for i in range(6)])
    assert H.main_text(model, page) == want


def test_decoding_never_takes_a_node_under_one_thrown_out():
    rng = np.random.default_rng(4)
    nodes = H.parse("<body>" + "<div><p>a<b>b</b></p><div>c<p>d</p></div></div>" * 3 + "</body>")
    place = {id(x): i for i, x in enumerate(nodes)}
    for _ in range(50):
        take = H.decode(nodes, rng.normal(size=len(nodes)) * 3)
        for i, x in enumerate(nodes):
            path = []
            while x is not None:
                path.append(bool(take[place[id(x)]]))
                x = x.parent
            changes = sum(a != b for a, b in zip(path, path[1:]))
            assert changes <= 2 and (changes < 2 or not path[0])


def test_decoding_is_the_best_choice():
    """Against all state assignments of a small tree."""
    import itertools

    nodes = H.parse("<div><p>a</p><p>b<i>c</i></p></div><p>d</p>")
    place = {id(x): i for i, x in enumerate(nodes)}
    parent = [place[id(x.parent)] if x.parent else -1 for x in nodes]
    rng = np.random.default_rng(8)
    for _ in range(20):
        z = rng.normal(size=len(nodes)) * 2
        best = max(sum(z[i] for i, s in enumerate(st) if s == 1) for st in itertools.product(range(3), repeat=len(nodes))
                   if st[0] < 2 and all(st[i] >= st[p] for i, p in enumerate(parent) if p >= 0))
        assert abs(z[H.decode(nodes, z)].sum() - best) < 1e-9


def test_text_blocks_white_space_and_references():
    nodes = H.parse("<p>a&nbsp;&lt;b&gt;\n\t c<b>d</b>e<br>f<p>g &#x27;h&#39; &amp;amp; <!-- no --> i</p><script>x<p></script>j")
    assert H.text_of(nodes, np.ones(len(nodes), bool)) == "a <b> cde f g 'h' &amp; i j"


@pytest.mark.parametrize("start", ["<html><head><meta charset=utf-8><title>T</title><noscript><img src=a></noscript>{}<body>",
                                   "<head><script>a</script>{}<header><p>Site</p></header>", "<head><title>T</title>\n{}Hello "])
def test_a_head_without_an_end_tag_ends_before_the_body(model, start):
    shape = lambda nodes: [(x.tag, x.depth, [c.strip() for c in x.children if isinstance(c, str) and c.strip()]) for x in nodes]
    rest = "<article>" + "".join(f"<p>{LONG * 3}{i}</p>" for i in range(6)) + "</article>"
    with_end, without = H.parse(start.format("</head>") + rest), H.parse(start.format("") + rest)
    assert shape(without) == shape(with_end) and H.truth(without) is not None
    assert H.main_text(model, start.format("") + rest).endswith(" ".join((LONG * 3).strip() + f" {i}" for i in range(6)))


def test_odd_pages(spark, model):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words, no tags"), (4, "u", deep), (5, "u", "<p><b>unclosed <i>tags <a href="),
            (None, None, "<article><p>" + LONG * 9 + "</p></article>"), (6, "u", "</div></p><li>x" + "y" * 500_000)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    real = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id + 1000 as page_id", "url", "html", "'k' as text", "1 as n_chars")
    got = {r.page_id: r for r in H.extract(pages.unionByName(real)).collect()}
    assert len(got) == len(rows) + real.count() and got[1].text == got[2].text == "" and got[None].text == (LONG * 9).strip()
    assert H.extract(pages.filter("1 = 0")).count() == 0
    same = H.extract(pages.unionByName(pages).filter("page_id = 2 or page_id is null")).collect()
    assert len(same) == 4
    assert [r.text for r in H.extract(pages.filter("page_id in (2, 3)")).collect()] == ["", ""]


@pytest.mark.parametrize("other", ["<div><p>plain</p></div>", "<article class='ad'><p>plain</p></article><!-- <main> -->"])
def test_a_table_where_one_page_in_two_thousand_marks_its_article(spark, other):
    real = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(12).select("page_id", "url", "html")
    rest = spark.range(10**6, 10**6 + 24_000, numPartitions=4).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<body>"), F.lit(other), F.col("id").cast("string")).alias("html"))
    got = {r.page_id: r.text for r in H.extract(real.unionByName(rest)).filter("page_id < 1000000").collect()}
    assert got == {r.page_id: article_text(r.html) for r in real.collect()}

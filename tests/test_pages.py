"""Text and links of hand-written pages."""

import random

import pytest
from pyspark.sql import functions as F

from webtrawl.functions import html, links
from webtrawl.functions.text import tokens

ROOT = "https://site.example"

# html -> text by the parser
EXACT = [
    ("<ul><li>a</li><li>b</li></ul>", "ab"),
    ("<title>t</title><script>var s='<p>x</p>';</script><style>p{}</style><meta x=1>k", "k"),
    ('<p title="a>b">x</p>', "x"),
    ("a<!-- b > c -->d", "a c --&gt;d".replace("--&gt;", "-->")),
    ("a<script>never closed <b>x</b>", "a"),
    ("a\tb\nc  d\n\n\te", "a\tb\nc d e"),
    ("a  b c", "a b c"),
    ("a\x1c\x1db", "a b"),
    ("&copy; &quot;x&quot; &amp; &lt;b&gt; &#65;&#x42;", '© "x" &amp; &lt;b&gt; AB'),
    ("&nosuch; x", "&amp;nosuch x"),
    ("<head><title>never closed<p>x</head>y", "y"),
    ("<!DOCTYPE html><br>x</br></p>", "x"),
    ("<b>a&amp</b>b &copy<i>c</i> AT&T x", "a&amp;b ©c AT&amp;T x"),
    ("", ""),
]

# What the patterns get right too.
NATIVE = [0, 1, 3, 4, 5, 6, 7, 11, 13]


def test_text_by_parser(spark):
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(EXACT)], "i int, html string")
    got = {r.i: r.c for r in df.select("i", html.parse_html("html")["content"].alias("c")).collect()}
    assert got == {i: text for i, (_, text) in enumerate(EXACT)}


def test_exact_text(spark):
    """Pages whose markup is plain never reach the parser, and read the same."""
    df = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(EXACT)] + [(-1, None), (-2, "<![bad[x]]>")], "i int, html string")
    found = df.select("i", html.plain_markup(F.col("html")).alias("plain"), html.exact_text(F.col("html")).alias("t"))
    rows = {r.i: r for r in found.collect()}
    assert {i: r.t.content for i, r in rows.items() if i >= 0} == {i: text for i, (_, text) in enumerate(EXACT)}
    assert rows[-1].t.content is None and rows[-1].t.error is None
    assert rows[-2].t.content is None and rows[-2].t.error
    assert 4 <= sum(bool(r.plain) for r in rows.values()) < len(EXACT)


PARTS = [
    "<p>", "</p>", "text ", "a > b", "<b class='x'>", "</b>", '<a href="q?a=1&amp;b">', "<!-- note -->", "<!-- <p> -->",
    "<!--> x -->", "<script>", "</script>", "if (a<b) x", "<style>p{}</style>", "<title>t</title>", "<title>a<b>c</title>",
    "&copy; &lt;", "&amp", "<br/>", "<img alt='>'>", "<", "<1", "<textarea><p></textarea>", "</script x>", "<!DOCTYPE html>",
    "<meta charset=utf-8>", "\n \n", "<input value=a/b>", "<p", "é&eacute;", "<svg><title>x</title></svg>", "<title>",
]


def test_plain_markup_reads_the_same(spark, sf_dir):
    """Random pages that are called plain, and the given ones, are the same by pattern and by parser."""
    draw = random.Random(8)
    made = ["".join(draw.choice(PARTS) for _ in range(draw.randrange(1, 9))) for _ in range(3_000)]
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select("html")
    pages = spark.createDataFrame([(p,) for p in made], "html string").unionByName(given)
    read = pages.where(html.plain_markup(F.col("html"))).select(
        "html", html.page_text(F.col("html"), decode=True).alias("a"), html.parse_html("html")["content"].alias("b")
    )
    rows = read.collect()
    assert len(rows) > 300
    assert [(r.html, r.a, r.b) for r in rows if r.a != r.b] == []
    assert given.where(~html.plain_markup(F.col("html"))).isEmpty()


def test_text_by_pattern(spark):
    df = spark.createDataFrame([(i, EXACT[i][0]) for i in NATIVE], "i int, html string")
    got = {r.i: r.c for r in df.select("i", html.page_text(F.col("html")).alias("c")).collect()}
    assert got == {i: EXACT[i][1] for i in NATIVE}


def test_text_options(spark):
    df = spark.createDataFrame([("<b>a</b><b>b</b> &amp;&lt;&nbsp;&copy;",)], "html string")
    row = df.select(
        html.page_text(F.col("html"), decode=True).alias("decoded"),
        html.page_text(F.col("html"), tag_replacement=" ", decode_amp=True).alias("apart"),
        html.page_text(F.lit("AT&T &amp; &quot;x&quot;"), decode=True).alias("bare"),
    ).first()
    closed = html.page_text(F.lit("<b>a&amp</b>b &copy<i>c</i> &copyleft"), decode=True)
    assert df.select(closed.alias("c")).first().c == "a&amp;b ©c &amp;copyleft"
    assert row.bare == 'AT&amp;T &amp; "x"'
    assert row.decoded == "ab &amp;&lt; ©"
    assert row.apart == " a b &< ©"


HREFS = (
    '<a href="one#x">1</a><a class="c" href=\'two\'>2</a><a href=three>3</a><a>none</a>'
    '<a name="n">none</a><!-- <a href="hidden">x</a> --><script>"<a href=\'s\'>"</script>'
    '<a href="q?a=1&amp;b=2">4</a><a href="">5</a><A HREF="six">6</A><a data-href="no">7</a>'
)


def test_hrefs(spark):
    df = spark.createDataFrame([(HREFS,)], "html string")
    row = df.select(
        html.page_hrefs(F.col("html")).alias("native"), html.parse_html("html")["hrefs"].alias("exact")
    ).first()
    assert row.native == row.exact == ["one#x", "two", "three", "q?a=1&b=2", "", "six"]


LINKS = [
    ("#top", ROOT + "/"),
    ("a#b#c", ROOT + "/a"),
    ("../x", ROOT + "/x"),
    ("x/../../y", ROOT + "/../y"),
    (ROOT + "/in", ROOT + "/in"),
    ("https://other.example/p", None),
    ("http://other.example/p", None),
    (f"https://other.example/?from={ROOT}", f"https://other.example/?from={ROOT}"),
    ("//host/p", ROOT + "///host/p"),
    ("/p", ROOT + "//p"),
    ("", ROOT + "/"),
    ("mailto:a@b.example", ROOT + "/mailto:a@b.example"),
    ("javascript:void(0)", ROOT + "/javascript:void(0)"),
]


def test_links(spark):
    df = spark.createDataFrame([(h,) for h, _ in LINKS], "href string")
    got = {r.href: r.link for r in df.select("href", links.absolute_link(F.col("href"), F.lit(ROOT)).alias("link")).collect()}
    assert got == dict(LINKS)


def test_page_links_are_distinct_and_internal(spark):
    df = spark.createDataFrame([(["a", "a#x", "https://other.example/", "b"],)], "hrefs array<string>")
    row = df.select(links.page_links(F.col("hrefs"), F.lit(ROOT)).alias("l")).first()
    assert row.l == [ROOT + "/a", ROOT + "/b"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("It's U.S.A. 3.14 x''y .e d. a.'b", ["it's", "u.s.a", "3.14", "x", "y", "e", "d", "a", "b"]),
        ("'q' Ünï_1 -- ", ["q", "ünï_1"]),
        ("...", []),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokens(F.col("t")).alias("x")).first().x == expected


def test_tokens_of_a_very_long_run(spark):
    df = spark.createDataFrame([(".".join(["a"] * 200_000),)], "t string")
    assert df.select(F.size(tokens(F.col("t"))).alias("n")).first().n == 1


def test_utf8_quarantine(spark):
    df = spark.createDataFrame([(0, b"caf\xc3\xa9"), (1, b"caf\xe9")], "i int, body binary")
    rows = df.select("i", html.decode_page(F.col("body")).alias("t"), html.repair_page(F.col("body")).alias("r"))
    got = {r.i: (r.t, r.r) for r in rows.collect()}
    assert got == {0: ("café", "café"), 1: (None, "caf�")}

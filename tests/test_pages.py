import random
import socket
import urllib.error

import pytest
from fixtures import GRAPH, fixture_rows, html
from pyspark.sql import functions as F

from linkloom import schema
from linkloom.functions import html as parsing
from linkloom.functions import links as fn
from linkloom.operators import graph, report
from linkloom.sources import fetch, fixtures

HREFS = {
    "/wiki/A": "/wiki/A", "/wiki/A?x=1#f": "/wiki/A", "/wiki/Category:X": "/wiki/Category:X", "/w/Foo:Bar": "/w/Foo:Bar", "Foo": "Foo", "./Foo": "./Foo", "/für": "/für",
    "https:/foo": "/foo", "#f": None, "?q": None, "": None, "mailto:a@b": None, "javascript:void(0)": None, "Foo:bar": None, "//h/p": None, "https://h/p": None,
    "/wiki/File:x.png": None, "/a b": None, "/a%2": None, "/a%20b": "/a%20b", "/a|b": None, "1a:b": None, "a:": None, ":x": None, "/a#b#c": None, "///x": "/x", "/w/index.php?title=X&redlink=1": "/w/index.php",
    "/a[1]": None, "/a?x=[1]": "/a", "/a b": None,
}


def test_internal_paths(spark):
    rows = spark.createDataFrame([(h,) for h in HREFS], "href string").select("href", fn.internal_path(F.col("href")).alias("p")).collect()
    assert {r.href: r.p for r in rows} == HREFS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "kind"), [("/wiki/A", "Article"), ("/wiki/Category:X", "/wiki/Category"), ("/wiki/A:b:c", "Article"), ("/wiki/A:", "Article"), (":::", "Article"), ("/wiki/A:B::", "/wiki/A")])
def test_article_type(spark, path, kind):
    assert one(spark, fn.article_type(F.lit(path), F.lit(False))) == kind
    assert one(spark, fn.article_type(F.lit(path), F.lit(True))) == "Disambiguation"


def test_titles_urls_and_locales(spark):
    assert one(spark, fn.normalised_title(F.lit("Black_hole__"))) == "Black hole"
    assert one(spark, fn.page_url(F.lit("/wiki/A"), "de")) == "https://de.wikipedia.org/wiki/A"
    assert one(spark, fn.url_path(F.lit("https://en.wikipedia.org/wiki/A?x#y"))) == "/wiki/A"
    locales = F.create_map(F.lit("en"), F.lit("/wiki/A:b:c"), F.lit("de"), F.lit("/wiki/B"))
    assert one(spark, fn.decode_locales(fn.encode_locales(locales))) == {"en": "/wiki/A:b:c", "de": "/wiki/B"}
    assert sorted(one(spark, fn.locale_urls(locales))) == ["https://de.wikipedia.org/wiki/B", "https://en.wikipedia.org/wiki/A:b:c"]


ARTICLE = """<html><head><meta name="robots" content="max-image-preview:standard"></head><body>
<h1 id="firstHeading">Second</h1><span class="mw-page-title-main">A  title</span>
<div id="p-lang"><ul><li><a href="https://de.wikipedia.org/wiki/T">de</a><li><a href="https://fr.wikipedia.org/wiki/U">fr</a></ul></div>
<div id="mw-content-text"><p class="x">not this<p id="y">nor this<p>First &lt;b&gt; <i>one</i><sup class="reference">[1]</sup> end
<p>Second</p><a href="/wiki/B#s">b</a><a href="/wiki/B">b</a><a href="">none</a><a href="https://x.org/">out</a></div>
<a href="/wiki/Outside">o</a><div id="catlinks"><a href="/wiki/Category:C">c</a></div></body></html>"""
REDIRECT = '<html><head></head><body><span class="mw-page-title-main">UK</span><span id="redirectsub"></span><div class="redirectMsg"><a href="/wiki/United_Kingdom">x</a></div><div class="redirectMsg"><a href="/wiki/Other">y</a></div><div id="catlinks"><a href="/c">c</a></div>{}</body></html>'
ROWS = {
    "/wiki/Help:A": ARTICLE,
    "/wiki/UK": REDIRECT.format('<div id="p-lang"></div>'),
    "/wiki/NoLang": REDIRECT.format(""),
    "/wiki/Red": '<html><head><meta name="robots" content="noindex,nofollow"></head><body></body></html>',
    "/wiki/Main": '<html><head><link rel="canonical" href="https://en.wikipedia.org/wiki/Main_Page"></head><body></body></html>',
    "/wiki/Empty": '<h1 id="firstHeading">E</h1>',
    "/wiki/Untitled": '<div id="mw-content-text"></div>',
    "/wiki/Null": None,
    "/wiki/Dis": '<h1 id="firstHeading">D</h1><div id="mw-content-text"><table class="a dmbox-body b"></table></div>',
    "/wiki/NoAnchor": '<h1 id="firstHeading">D</h1><div id="p-lang"><li>none</li></div><div id="mw-content-text"></div>',
    "/wiki/BadLang": '<h1 id="firstHeading">D</h1><div id="p-lang"><li><a href="https://[bad">x</a></li></div><div id="mw-content-text"></div>',
    "/wiki/NoUrl": '<h1 id="firstHeading">D</h1><div id="p-lang"><li><a href="/wiki/T">x</a></li></div><div id="mw-content-text"></div>',
}


def test_analyzers(spark):
    table = spark.createDataFrame(list(ROWS.items()), "path string, html string")
    got = {r.path: r for r in parsing.parse_documents(table).collect()}
    a = got["/wiki/Help:A"]
    assert (a.title, a.description, a.article_type, a.is_redirect, a.error) == ("A title", "First &lt;b&gt; one end\n", "/wiki/Help", False, None)
    assert sorted(a.links) == ["/wiki/B", "/wiki/Category:C"]
    assert a.locales == {"en": "/wiki/Help:A", "de": "/wiki/T", "fr": "/wiki/U"}
    u = got["/wiki/UK"]
    assert (u.title, u.description, u.article_type, u.is_redirect, u.links, u.locales) == ("UK", "UK redirect", "", True, ["/wiki/United_Kingdom"], {"en": "/wiki/UK"})
    assert got["/wiki/Dis"].article_type == "Disambiguation" and got["/wiki/Dis"].description == ""
    assert {p: (r.route, r.error) for p, r in got.items() if r.error} == {
        "/wiki/NoLang": ("unlink", "redirect-without-languages"),
        "/wiki/Red": ("unlink", "robots-keep-off"),
        "/wiki/Main": ("unlink", "front-page"),
        "/wiki/Empty": ("unlink", "no-content"),
        "/wiki/Untitled": ("unlink", "no-title"),
        "/wiki/Null": ("unlink", "no-document"),
        "/wiki/NoAnchor": ("stash", "language-without-link"),
        "/wiki/BadLang": ("unlink", "bad-language-link"),
        "/wiki/NoUrl": ("unlink", "bad-language-link"),
    }


def test_an_analyzer_that_fails_stops_no_other_document(spark):
    def factory():
        def analyze(path, markup):
            if markup == "bad":
                raise KeyError(markup)
            return {"title": markup, "description": "", "is_redirect": False, "disambiguation": None, "locales": {}, "links": []}

        return analyze

    rows = parsing.parse_documents(spark.createDataFrame([("/a", "good"), ("/b", "bad")], "path string, html string"), factory).collect()
    assert {(r.path, r.title, r.route, r.error) for r in rows} == {("/a", "good", "index", None), ("/b", None, "stash", "unexpected KeyError")}


def test_fixture_round_trip(spark, tmp_path):
    table = spark.createDataFrame(fixture_rows(), "name string, title string, description string, links array<string>")
    folder = f"file://{tmp_path}"
    fixtures.write_fixtures(table, folder)
    assert sorted(map(tuple, fixtures.read_fixtures(spark, folder).collect())) == sorted(map(tuple, table.collect()))
    pages = fixtures.as_pages(table).select(F.concat(F.lit("/wiki/"), "name").alias("path"), "html")
    parsed = {r.path: r for r in parsing.parse_documents(pages, parsing.fixture_analyzer).collect()}
    assert {p: set(r.links) for p, r in parsed.items()} == {f"/wiki/{n}": {f"/wiki/{x}" for x in v[2]} for n, v in GRAPH.items()}
    assert parsed["/wiki/3"].description == GRAPH["3"][1]
    found = fetch.FileSource(folder)(spark.createDataFrame([("/wiki/3",), ("/wiki/99",), ("x",)], "path string")).collect()
    assert {r.path: r.status for r in found} == {"/wiki/3": schema.SUCCESS, "/wiki/99": schema.DOES_NOT_EXIST, "x": schema.DOES_NOT_EXIST}


def test_table_source(spark):
    source = fetch.TableSource(spark.createDataFrame(html(), "name string, html string"))
    more = source.add(spark.createDataFrame([("1", "other"), ("8", "new")], "name string, html string"))
    asked = spark.createDataFrame([("/wiki/1",), ("/wiki/8",)], "path string")
    rows = {r.path: r.html for r in more(asked).collect()}
    assert rows["/wiki/8"] == "new" and rows["/wiki/1"] != "other"
    assert {r.status for r in more.remove(asked.selectExpr("substr(path, 7) AS name"))(asked).collect()} == {schema.DOES_NOT_EXIST}


def test_web_source(spark):
    def transport(url):
        name = url.rsplit("/", 1)[1]
        if name == "gone":
            raise urllib.error.HTTPError(url, 404, "no", None, None)
        if name == "lost":
            raise urllib.error.URLError(socket.gaierror("no host"))
        if name == "slow":
            raise TimeoutError
        return f"text of {url}"

    asked = spark.createDataFrame([(f"/wiki/{n}",) for n in ("a", "gone", "lost", "slow")], "path string")
    rows = {r.path: (r.status, r.html) for r in fetch.WebSource(transport, parallelism=2)(asked).collect()}
    assert rows == {
        "/wiki/a": (schema.SUCCESS, "text of https://en.wikipedia.org/wiki/a"),
        "/wiki/gone": (schema.DOES_NOT_EXIST, None),
        "/wiki/lost": (schema.CONNECTION_ERROR, None),
        "/wiki/slow": (schema.CONNECTION_ERROR, None),
    }


def _sets(spark, side: int):
    r = random.Random(side)
    rows = [(k, sorted(r.sample("abcdefghij", r.randrange(4)))) for k in range(300)] + [(None, ["a", "b"])]
    return {k: set(w) for k, w in rows}, spark.createDataFrame(rows, "page_id long, words array<string>")


def test_pages_that_share_words_are_paired_without_a_shuffle_of_pairs(spark):
    (a, left), (b, right) = _sets(spark, 1), _sets(spark, 2)
    pairs = graph.sharing_pairs(left, right, "page_id", "words")
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in a for y in b if a[x] & b[y]}
    shown = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in shown[: shown.index("Join")]


def _groups(spark):
    """Pages of three groups, some of equal titles, and edges that are those of the groups."""
    pages = [(str(k), f"t{k % 7}" if k % 5 else None, f"g{k % 3}" if k else None) for k in range(20)]
    near = {"g0": ["1", "8", "3"], "g1": ["15", "2"], "g2": []}
    edges = [(p, d) for p, _, g in pages if g for d in near[g]]
    title = {p: t for p, t, _ in pages}
    shared = [(g, title[d], 1) for g in near for d in near[g]]
    return [spark.createDataFrame(rows, kind) for rows, kind in ((pages, "path string, title string, group string"), (edges, "src string, dst string"), (shared, "group string, name string, n long"))]


def test_a_listing_of_groups_is_that_of_pages(spark):
    pages, edges, near = _groups(spark)
    got = report.shared_listing(pages, report.lines_of(near, "group"), "group").collect()
    assert sorted(map(str, got)) == sorted(map(str, report.adjacency_listing(pages.drop("group"), edges).collect())) and len(got) == 20


def test_a_card_of_groups_is_that_of_pages(spark):
    pages, edges, near = _groups(spark)
    more = ["'' AS description", "'Article' AS article_type", "1L AS unique_id", "true AS is_removed", "false AS is_redirect"]
    pages = pages.selectExpr("*", *more)
    got = report.shared_card(pages, report.lines_of(near, "group"), "group", F.col("path")).collect()
    assert sorted(map(str, got)) == sorted(map(str, report.page_card(pages.drop("group"), edges, F.col("path")).collect())) and len(got) == 20

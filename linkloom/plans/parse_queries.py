"""Queries through the analyzers and the page sources; the markup is made from table rows, so SQL knows what must come out."""

from __future__ import annotations

import socket
import urllib.error

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import links as fn
from linkloom.functions.html import fixture_analyzer, parse_documents
from linkloom.plans.registry import query
from linkloom.scratch import new_path
from linkloom.sources import fetch, fixtures
from linkloom.sources.tables import table

#: Faults by part key: robots keep off, the front page, no content, a language without link, a bad language link, no document.
_FAULT = """CASE WHEN p_partkey % 37 = 0 THEN 'no-document' WHEN p_partkey % 11 = 0 THEN 'robots-keep-off' WHEN p_partkey % 13 = 0 THEN 'front-page'
  WHEN p_partkey % 7 = 0 THEN (CASE WHEN p_partkey % 5 = 1 THEN 'redirect-without-languages' END)
  WHEN p_partkey % 31 = 0 THEN 'no-title' WHEN p_partkey % 23 = 0 THEN 'language-without-link' WHEN p_partkey % 29 = 0 THEN 'bad-language-link'
  WHEN p_partkey % 19 = 0 THEN 'no-content' END"""
_WIKI = f"""w AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '/wiki/Help:' ELSE '/wiki/' END || p_partkey AS path, {_FAULT} AS fault,
  p_partkey % 7 = 0 AS is_redirect, replace(p_brand, '#', '') AS brand FROM part)"""


def wiki_pages(spark, sf_dir: str) -> DataFrame:
    """(path, html): each part as a page of a wiki: an article, a redirect, or one with a fault."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    given = lambda test, *parts: F.when(test, text(*parts)).otherwise("")
    plus = lambda n: (k + n).cast("string")
    robots = F.when(k % 11 == 0, "noindex,nofollow").otherwise("max-image-preview:standard")
    head = text('<html><head><meta name="robots" content="', robots, '">', given(k % 13 == 0, '<link rel="canonical" href="https://en.wikipedia.org/wiki/Main_Page">'), "</head><body>")
    title = F.when((k % 31 == 0) & (k % 7 != 0), "").otherwise(text('<h1 id="firstHeading">heading ', key, "</h1>", given(k % 5 != 0, '<span class="mw-page-title-main">', F.col("p_name"), "</span>")))
    redirect = given(k % 7 == 0, '<span id="redirectsub"></span><div class="redirectMsg"><a href="/wiki/', plus(1), '">x</a></div><div class="redirectMsg"><a href="/wiki/no">y</a></div>')
    german = F.when(k % 23 == 0, "<li>none</li>").when(k % 29 == 0, '<li><a href="https://[bad">x</a></li>').otherwise(text('<li><a href="https://de.wikipedia.org/wiki/', key, '">de</a></li>'))
    german = F.when(k % 7 == 0, text('<li><a href="https://de.wikipedia.org/wiki/', key, '">de</a></li>')).otherwise(german)
    languages = F.when((k % 7 == 0) & (k % 5 == 1), "").otherwise(text('<div id="p-lang"><ul>', german, '<li><a href="https://fr.wikipedia.org/wiki/F', key, '">fr</a></ul></div>'))
    content = text(
        '<div id="mw-content-text"><p class="x">not this<p id="y">nor this<p>', F.col("p_type"), " &amp; <b>", F.col("p_name"), '</b><sup class="reference">[1]</sup></p><p>later</p><a href="/wiki/', plus(1),
        '#s">n</a><a href="/wiki/', plus(2), '?q=1">m</a><a href="/wiki/File:a.png">f</a><a href="">e</a><a href="https://x.org/">o</a>', given(k % 17 == 0, '<table class="a dmbox-body"></table>'), "</div>",
    )
    body = text(F.when((k % 19 == 0) & (k % 7 != 0), "").otherwise(content), '<a href="/wiki/Outside">o</a><div id="catlinks"><a href="/wiki/Category:', F.translate("p_brand", "#", ""), '">c</a><a href="/wiki/', plus(1), '">n</a></div></body></html>')
    path = text(F.when(k % 3 == 0, "/wiki/Help:").otherwise("/wiki/"), key)
    html = F.when(k % 37 != 0, text(head, title, redirect, languages, body))
    return table(spark, sf_dir, "part").select(path.alias("path"), html.alias("html"))


def _shown(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", "title", "description", "article_type", F.array_join(F.array_sort("links"), ",").alias("links"), F.array_join(fn.encode_locales(F.col("locales")), ",").alias("locales"))


_LOCALES = "'de:/wiki/' || p_partkey || ',en:' || path || ',fr:/wiki/F' || p_partkey AS locales"


@query(
    "wiki_articles",
    f"""WITH {_WIKI} SELECT path, CASE WHEN p_partkey % 5 = 0 THEN 'heading ' || p_partkey ELSE p_name END AS title, p_type || ' &amp; ' || p_name AS description,
      CASE WHEN p_partkey % 17 = 0 THEN 'Disambiguation' WHEN p_partkey % 3 = 0 THEN '/wiki/Help' ELSE 'Article' END AS article_type,
      (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT unnest(['/wiki/' || (p_partkey + 1), '/wiki/' || (p_partkey + 2), '/wiki/Category:' || brand]) AS x)) AS links,
      {_LOCALES} FROM w WHERE fault IS NULL AND NOT is_redirect""",
)
def wiki_articles(spark, sf_dir):
    """Title, description, type, languages and links of the content and the categories together."""
    parsed = parse_documents(wiki_pages(spark, sf_dir))
    return _shown(parsed.where("route = 'index' and not is_redirect"))


@query(
    "wiki_redirects",
    f"""WITH {_WIKI}, t AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'heading ' || p_partkey ELSE p_name END AS title FROM w)
    SELECT path, title, title || ' redirect' AS description, '' AS article_type, '/wiki/' || (p_partkey + 1) AS links, {_LOCALES} FROM t WHERE fault IS NULL AND is_redirect""",
)
def wiki_redirects(spark, sf_dir):
    """Links of the first message only."""
    parsed = parse_documents(wiki_pages(spark, sf_dir))
    return _shown(parsed.where("route = 'index' and is_redirect"))


@query("wiki_faults", f"WITH {_WIKI} SELECT path, CASE WHEN fault = 'language-without-link' THEN 'stash' ELSE 'unlink' END AS route, fault AS error FROM w WHERE fault IS NOT NULL")
def wiki_faults(spark, sf_dir):
    """Documents that are no page, and where they go; no document stops the others."""
    return parse_documents(wiki_pages(spark, sf_dir)).where("error is not null").select("path", "route", "error")


@query(
    "fixture_parse",
    """SELECT '/wiki/' || p_partkey AS path, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS description,
    '/wiki/' || (p_partkey + 1) || ',/wiki/x' || p_size AS links FROM part""",
)
def fixture_parse(spark, sf_dir):
    """Small test pages through their own analyzer."""
    key = F.col("p_partkey")
    links = F.array(F.concat(F.lit("/wiki/"), (key + 1).cast("string")), F.concat(F.lit("/wiki/x"), F.col("p_size").cast("string")))
    html = fixtures.fixture_text(F.col("p_name"), F.when(key % 4 != 0, F.col("p_type")), links)
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("/wiki/"), key.cast("string")).alias("path"), html.alias("html"))
    parsed = parse_documents(pages, fixture_analyzer)
    return parsed.select("path", "title", "description", F.array_join(F.array_sort("links"), ",").alias("links"))


# -- sources: nations and regions as fixture files ----------------------------------


def nation_fixtures(spark, sf_dir: str) -> DataFrame:
    """A page per nation, which leads to its region, and one per region, which leads to its nations and to all regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    page = lambda kind, key: F.concat(F.lit(f"/wiki/{kind}"), F.col(key).cast("string"))
    out = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.translate("n_name", "_", " ").alias("title"), F.lit("").alias("description"), F.array(page("r", "n_regionkey")).alias("links"))
    all_regions = region.agg(F.array_sort(F.collect_set(page("r", "r_regionkey"))).alias("regions"))  # one row
    theirs = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_set(page("n", "n_nationkey"))).alias("nations"))
    lines = region.join(theirs, "r_regionkey", "left").crossJoin(F.broadcast(all_regions))
    links = F.array_union("regions", F.coalesce("nations", F.array().cast("array<string>")))
    return out.unionByName(lines.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("title"), F.concat(F.lit("region "), F.col("r_name")).alias("description"), links.alias("links")))


#: The same as SQL: (name, title, description, links), links as rows (src, dst).
NATIONS = """f AS (SELECT 'n' || n_nationkey AS name, replace(n_name, '_', ' ') AS title, '' AS description FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'region ' || r_name FROM region),
  l AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
    UNION SELECT 'r' || a.r_regionkey, 'r' || b.r_regionkey FROM region a, region b)"""
_TEXT = """t AS (SELECT name, title, description, (SELECT string_agg('/wiki/' || dst, ',' ORDER BY dst) FROM l WHERE src = name) AS links FROM f)"""


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("name", "title", "description", F.array_join(F.array_sort("links"), ",").alias("links"))


def fixture_folder(spark, sf_dir: str) -> str:
    folder = new_path(spark, "fixtures")
    fixtures.write_fixtures(nation_fixtures(spark, sf_dir), folder)
    return folder


@query("fixture_files", f"WITH {NATIONS}, {_TEXT} SELECT name, title, description, links FROM t")
def fixture_files(spark, sf_dir):
    """Written as files, and read back from their folder."""
    return _flat(fixtures.read_fixtures(spark, fixture_folder(spark, sf_dir)))


@query(
    "fixture_edits",
    f"""WITH {NATIONS}, m AS (SELECT * FROM l WHERE NOT (src LIKE 'r%' AND dst LIKE 'r%') UNION SELECT name, 'new' FROM f WHERE name LIKE 'n%')
    SELECT name, CASE WHEN name LIKE 'n%' THEN lower(title) ELSE title END AS title, CASE WHEN name LIKE 'n%' THEN 'a nation' ELSE description END AS description,
    coalesce((SELECT string_agg('/wiki/' || dst, ',' ORDER BY dst) FROM m WHERE src = name), '') AS links FROM f""",
)
def fixture_edits(spark, sf_dir):
    """Nations are renamed, described and gain a link; regions lose their links to regions."""
    rows = nation_fixtures(spark, sf_dir)
    nations = rows.where("name like 'n%'")
    rows = fixtures.retitled(rows, nations.select("name", F.lower("title").alias("title")))
    rows = fixtures.redescribed(rows, nations.select("name", F.lit("a nation").alias("description")))
    rows = fixtures.with_links(rows, nations.select("name", F.lit("/wiki/new").alias("link")))
    between = rows.where("name like 'r%'").select("name", F.explode("links").alias("link")).where("link like '/wiki/r%'")
    return _flat(fixtures.without_links(rows, between))


_ASKED = "a AS (SELECT '/wiki/n' || p_partkey AS path, 'n' || p_partkey AS name FROM part UNION ALL SELECT '/odd', NULL)"
_FETCHED = "SELECT path, CASE WHEN f.name IS NULL THEN 'DOES_NOT_EXIST' ELSE 'SUCCESS' END AS status, title FROM a LEFT JOIN f USING (name)"


def _asked(spark, sf_dir) -> DataFrame:
    """Far more paths than there are pages, and one that names none."""
    paths = table(spark, sf_dir, "part").select(F.concat(F.lit("/wiki/n"), F.col("p_partkey").cast("string")).alias("path"))
    return paths.unionByName(spark.createDataFrame([("/odd",)], "path string"))


def _titles(fetched: DataFrame) -> DataFrame:
    return fetched.select("path", "status", F.when(F.col("html").isNotNull(), F.regexp_extract("html", '<p id = "title">([^<]*)', 1)).alias("title"))


@query("fetch_files", f"WITH {NATIONS}, {_ASKED} {_FETCHED}")
def fetch_files(spark, sf_dir):
    return _titles(fetch.FileSource(fixture_folder(spark, sf_dir))(_asked(spark, sf_dir)))


@query("fetch_table", f"WITH {NATIONS}, {_ASKED} {_FETCHED}")
def fetch_table(spark, sf_dir):
    return _titles(fetch.TableSource(fixtures.as_pages(nation_fixtures(spark, sf_dir)))(_asked(spark, sf_dir)))


@query(
    "fetch_table_edited",
    f"""WITH {NATIONS}, {_ASKED}, g AS (SELECT name, title FROM f WHERE name <> 'n3' UNION ALL SELECT 'n' || c_custkey, c_name FROM customer WHERE 'n' || c_custkey NOT IN (SELECT name FROM f))
    SELECT path, CASE WHEN g.name IS NULL THEN 'DOES_NOT_EXIST' ELSE 'SUCCESS' END AS status, title FROM a LEFT JOIN g USING (name)""",
)
def fetch_table_edited(spark, sf_dir):
    """Customers are added under names that nations may have already (the first stays); then one page is removed."""
    source = fetch.TableSource(fixtures.as_pages(nation_fixtures(spark, sf_dir)))
    title = F.concat(F.lit('<p id = "title">'), "c_name", F.lit("</p>"))
    more = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"), title.alias("html"))
    edited = source.add(more).remove(spark.createDataFrame([("n3",)], "name string"))
    return _titles(edited(_asked(spark, sf_dir)))


def _transport(url: str) -> str:
    """A web of its own: some hosts are unknown, some answers late, some pages gone, the rest names itself."""
    key = int(url.rsplit("/", 1)[1])
    if key % 7 == 0:
        raise urllib.error.HTTPError(url, 404, "gone", None, None)
    if key % 11 == 0:
        raise urllib.error.URLError(socket.gaierror("no host"))
    if key % 13 == 0:
        raise TimeoutError
    if key % 17 == 0:
        raise ConnectionResetError
    return f"page at {url}"


@query(
    "fetch_web",
    """SELECT '/wiki/' || c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 'DOES_NOT_EXIST' WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'CONNECTION_ERROR'
    WHEN c_custkey % 17 = 0 THEN 'DOES_NOT_EXIST' ELSE 'SUCCESS' END AS status,
    CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 THEN 'page at https://en.wikipedia.org/wiki/' || c_custkey END AS html FROM customer""",
)
def fetch_web(spark, sf_dir):
    """The web source over a transport that needs no network."""
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("/wiki/"), F.col("c_custkey").cast("string")).alias("path"))
    return fetch.WebSource(_transport)(asked).select("path", "status", "html")

"""Queries over raw pages: links, titles, paths, lookups, edges by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import links as fn
from linkloom.functions.html import GENERIC, analyzer, parse_documents, titles
from linkloom.operators import graph, report
from linkloom.plans.registry import query
from linkloom.sources.tables import table

_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_TITLE = "regexp_extract(html, '<h1>([^<]*)', 1)"
_PAGES = f"SELECT page_id, {_PATH} AS path, {_TITLE} AS title FROM pages"
_HREFS = "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages"
_INTERNAL = rf"""
SELECT DISTINCT page_id, path FROM (
  SELECT page_id, href, regexp_extract(href, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?([^?#]*)', 1) AS path
  FROM ({_HREFS})
  WHERE href <> ''
    AND NOT regexp_matches(href, '[\x00-\x20\x7f-\x{{a0}}"<>\\^`{{|}}]')
    AND NOT contains(regexp_replace(href, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')
    AND NOT (regexp_matches(href, '^[^/?#:]*:') AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:.'))
    AND NOT regexp_matches(href, '#.*#')
    AND NOT regexp_matches(href, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]')
    AND NOT regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:[^/]')
) WHERE path <> '' AND NOT contains(path, 'File:')"""


def raw_pages(spark, sf_dir: str) -> DataFrame:
    """page_id, path and title of raw pages, without parsing."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", fn.url_path(F.col("url")).alias("path"), titles(F.col("html")).alias("title"))


def word_links(spark, sf_dir: str) -> DataFrame:
    """(page_id, word): the words that a page's links name, without the leading slash."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(fn.internal_paths(fn.hrefs(F.col("html")))).alias("path"))
    return found.select("page_id", F.regexp_replace("path", "^/", "").alias("word"))


@query("page_links", f"SELECT page_id, href, count(*) AS n FROM ({_HREFS}) WHERE href <> '' GROUP BY ALL")
def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(fn.hrefs(F.col("html"))).alias("href"))
    return found.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("internal_links", _INTERNAL)
def internal_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(fn.internal_paths(fn.hrefs(F.col("html")))).alias("path"))


@query("internal_links_parsed", _INTERNAL)
def internal_links_parsed(spark, sf_dir):
    """The same by way of the HTML tree."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), "html")
    parsed = parse_documents(pages, lambda: analyzer(GENERIC))
    return parsed.select(F.col("path").cast("long").alias("page_id"), F.explode("links").alias("path"))


@query("page_titles", f"SELECT page_id, title FROM ({_PAGES})")
def page_titles(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", "title")


@query("link_paths", f"SELECT page_id, path FROM ({_PAGES})")
def link_paths(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", "path")


@query("link_urls", f"SELECT page_id, 'https://en.wikipedia.org' || path AS url FROM ({_PAGES})")
def link_urls(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", fn.page_url(F.col("path")).alias("url"))


@query(
    "locale_urls",
    "SELECT doc_id, 'https://' || lang || '.wikipedia.org/wiki/' || doc_id AS url FROM documents WHERE lang IS NOT NULL",
)
def locale_urls(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang is not null")
    locales = F.create_map("lang", F.concat(F.lit("/wiki/"), F.col("doc_id").cast("string")))
    codec = fn.decode_locales(fn.encode_locales(locales))
    return docs.select("doc_id", F.explode(fn.locale_urls(codec)).alias("url"))


@query(
    "article_type",
    """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Disambiguation' WHEN len(p) = 2 THEN p[1] ELSE 'Article' END AS article_type
    FROM (SELECT page_id, string_split(regexp_replace('/wiki/' || replace(title, ' ', ':'), ':+$', ''), ':') AS p
          FROM (SELECT page_id, regexp_extract(html, '<h1>([^ <]* ?[^ <]?)', 1) AS title FROM pages))""",
)
def article_type(spark, sf_dir):
    """Paths made from the first words of titles, so that some have one colon."""
    pages = table(spark, sf_dir, "pages")
    head = F.regexp_extract("html", r"<h1>([^ <]* ?[^ <]?)", 1)
    path = F.concat(F.lit("/wiki/"), F.translate(head, " ", ":"))
    return pages.select("page_id", fn.article_type(path, F.col("page_id") % 7 == 0).alias("article_type"))


@query(
    "title_normalise",
    "SELECT p_partkey, replace(regexp_replace(replace(p_name, ' ', '_') || repeat('_', CAST(p_partkey % 3 AS INTEGER)), '_+$', ''), '_', ' ') AS title FROM part",
)
def title_normalise(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    typed = F.concat(F.translate("p_name", " ", "_"), F.expr("repeat('_', cast(p_partkey % 3 as int))"))
    return part.select("p_partkey", fn.normalised_title(typed).alias("title"))


@query("all_pages", f"SELECT page_id, path, title FROM ({_PAGES})")
def all_pages(spark, sf_dir):
    return raw_pages(spark, sf_dir)


@query("page_count", f"SELECT count(*) AS n_pages, count(DISTINCT title) AS n_titles FROM ({_PAGES})")
def page_count(spark, sf_dir):
    return graph.count_pages(raw_pages(spark, sf_dir))


@query("link_count", f"SELECT count(DISTINCT path) AS n_links FROM ({_INTERNAL})")
def link_count(spark, sf_dir):
    return internal_links(spark, sf_dir).agg(F.count_distinct("path").alias("n_links"))


@query("page_by_title", f"WITH p AS ({_PAGES}) SELECT page_id, path, title FROM p WHERE title = (SELECT min(title) FROM p WHERE title <> '')")
def page_by_title(spark, sf_dir):
    pages = raw_pages(spark, sf_dir)
    return graph.page_by_title(pages, pages.where("title <> ''").agg(F.min("title")).first()[0])


@query("page_by_id", f"SELECT page_id, path, title FROM ({_PAGES}) WHERE page_id = 17")
def page_by_id(spark, sf_dir):
    pages = raw_pages(spark, sf_dir).withColumnRenamed("page_id", "unique_id")
    return graph.page_by_id(pages, 17).withColumnRenamed("unique_id", "page_id")


@query("page_by_link", f"WITH p AS ({_PAGES}) SELECT page_id, path, title FROM p WHERE path = (SELECT max(path) FROM p)")
def page_by_link(spark, sf_dir):
    pages = raw_pages(spark, sf_dir)
    return graph.page_by_path(pages, pages.agg(F.max("path")).first()[0])


@query("pages_by_title", f"SELECT title, max(page_id) AS page_id FROM ({_PAGES}) GROUP BY title")
def pages_by_title(spark, sf_dir):
    return graph.last_by_title(raw_pages(spark, sf_dir), "page_id").select("title", "page_id")


@query("pages_in_links", f"WITH p AS ({_PAGES}) SELECT page_id, path, title FROM p WHERE path IN (SELECT path FROM p WHERE page_id % 5 = 0)")
def pages_in_links(spark, sf_dir):
    pages = raw_pages(spark, sf_dir)
    return graph.pages_in(pages, pages.where("page_id % 5 = 0"))


@query(
    "title_batch",
    f"WITH p AS ({_PAGES}), a AS (SELECT DISTINCT title FROM p WHERE page_id < 6 AND title <> '') "
    "SELECT a.title, max(p.page_id) AS page_id FROM a JOIN p USING (title) GROUP BY a.title",
)
def title_batch(spark, sf_dir):
    pages = raw_pages(spark, sf_dir)
    asked = pages.where("page_id < 6 and title <> ''").select("title").distinct().withColumn("position", F.lit(0).cast("long"))
    keyed = pages.select("title", F.col("page_id").alias("unique_id"), F.col("page_id").cast("string").alias("path"))
    return graph.resolve_titles(keyed, asked).select("title", F.col("path").cast("long").alias("page_id"))


@query("title_batch_unknown", "SELECT 'x' AS title, CAST(1 AS BIGINT) AS page_id WHERE false")
def title_batch_unknown(spark, sf_dir):
    """One unknown title leaves nothing."""
    pages = raw_pages(spark, sf_dir)
    asked = pages.where("page_id < 6").select("title").distinct().unionByName(spark.sql("SELECT 'no such title' AS title")).withColumn("position", F.lit(0).cast("long"))
    keyed = pages.select("title", F.col("page_id").alias("unique_id"), F.col("page_id").cast("string").alias("path"))
    return graph.resolve_titles(keyed, asked).select("title", F.col("path").cast("long").alias("page_id"))


# -- the title graph: a page links to each page whose title has a word that a link names ---------

_WORDS = rf"""raw AS (SELECT DISTINCT page_id, regexp_replace(path, '^/', '') AS word FROM ({_INTERNAL})),
named AS (SELECT DISTINCT page_id, unnest(string_split(title, ' ')) AS word FROM ({_PAGES})),
known AS (SELECT DISTINCT word FROM named WHERE word <> '')"""


def _words(spark, sf_dir):
    named = raw_pages(spark, sf_dir).select("page_id", F.explode(F.split("title", " ")).alias("word")).where("word <> ''").distinct()
    raw = word_links(spark, sf_dir).select(F.col("page_id").alias("src_path"), F.col("word").alias("dst_path"))
    return raw, named.select(F.col("word").alias("path"), "page_id")


@query("resolved_edges", f"WITH {_WORDS} SELECT DISTINCT page_id AS src, word AS dst FROM raw JOIN known USING (word)")
def resolved_edges(spark, sf_dir):
    raw, named = _words(spark, sf_dir)
    return graph.resolved_edges(raw, named)


def _word_sets(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(page_id, words): of pages that link, the words their links name, and of titled pages those their titles have; only words that both sides have."""
    raw, named = _words(spark, sf_dir)
    raw = raw.select(F.col("src_path").alias("page_id"), F.col("dst_path").alias("word"))
    named = named.select("page_id", F.col("path").alias("word"))
    sides = [(x, y.select("word").distinct()) for x, y in ((raw, named), (named, raw))]
    return tuple(x.join(y, "word", "left_semi").groupBy("page_id").agg(F.array_sort(F.collect_set("word")).alias("words")) for x, y in sides)


@query("title_graph", f"WITH {_WORDS} SELECT DISTINCT r.page_id AS src, n.page_id AS dst FROM raw r JOIN named n USING (word)")
def title_graph(spark, sf_dir):
    """Pages of equal word sets are paired as groups; only the rows of groups are shuffled, never the pairs."""
    return graph.sharing_pairs(*_word_sets(spark, sf_dir), "page_id", "words")


def _shared_lines(spark, sf_dir, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages`` with ``group`` (the words their links name), and (group, lines): pages of one group list the same titles, so those are put in order once."""
    linking, titled = _word_sets(spark, sf_dir)
    titles = raw_pages(spark, sf_dir).select("page_id", "title").join(titled, "page_id").groupBy("words", "title").agg(F.count("*").alias("n"))
    groups = linking.select(F.col("words").alias("group")).distinct()
    near = graph.sharing(groups.withColumn("words", F.col("group")), titles, "words").select("group", F.col("title").alias("name"), "n")
    of = linking.select(F.col("page_id").cast("string").alias("path"), F.col("words").alias("group"))
    return pages.join(of, "path", "left"), report.lines_of(near, "group")


@query("dangling_links", f"WITH {_WORDS} SELECT page_id, word FROM raw WHERE word NOT IN (SELECT word FROM known)")
def dangling_links(spark, sf_dir):
    raw, named = _words(spark, sf_dir)
    return graph.dangling_links(raw, named).toDF("page_id", "word")


@query(
    "pending_sources",
    f"""WITH {_WORDS}, d AS (SELECT page_id, word FROM raw WHERE word NOT IN (SELECT word FROM known))
    SELECT word, count(*) AS n, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) AS sources FROM d GROUP BY word""",
)
def pending_sources(spark, sf_dir):
    raw, named = _words(spark, sf_dir)
    pending = graph.pending_sources(graph.dangling_links(raw, named))
    text = F.array_join(F.transform("sources", lambda s: s.cast("string")), ",")
    return pending.select(F.col("dst_path").alias("word"), F.size("sources").cast("long").alias("n"), text.alias("sources"))


@query(
    "late_edge_completion",
    f"""WITH {_WORDS}, early AS (SELECT DISTINCT word FROM named WHERE page_id % 2 = 0)
    SELECT DISTINCT page_id AS src, word AS dst FROM raw
    WHERE word IN (SELECT word FROM named WHERE page_id % 2 = 1 AND word <> '') AND word NOT IN (SELECT word FROM early)""",
)
def late_edge_completion(spark, sf_dir):
    """Pages with even ids are known first; the others arrive and complete what waits for them."""
    raw, named = _words(spark, sf_dir)
    waiting = graph.dangling_links(raw, named.where("page_id % 2 = 0"))
    return graph.complete_edges(waiting, named.where("page_id % 2 = 1"))


@query(
    "adjacency_listing",
    f"""WITH {_WORDS}, e AS (SELECT DISTINCT r.page_id AS src, n.page_id AS dst FROM raw r JOIN named n USING (word)), p AS ({_PAGES}),
    l AS (SELECT src, string_agg(chr(10) || ' - ' || title, '' ORDER BY title COLLATE "C") AS lines FROM e JOIN p ON p.page_id = dst GROUP BY src)
    SELECT CAST(page_id AS VARCHAR) AS path, title, title || coalesce(lines, '') AS listing FROM p LEFT JOIN l ON l.src = page_id""".replace(' COLLATE "C"', ""),
)
def adjacency_listing(spark, sf_dir):
    pages = raw_pages(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), "title")
    return report.shared_listing(*_shared_lines(spark, sf_dir, pages), "group")


@query(
    "page_card",
    f"""WITH {_WORDS}, e AS (SELECT DISTINCT r.page_id AS src, n.page_id AS dst FROM raw r JOIN named n USING (word)), p AS ({_PAGES}),
    g AS (SELECT src, string_agg(chr(10) || ' - ' || title, '' ORDER BY title) AS lines FROM e JOIN p ON p.page_id = dst GROUP BY src)
    SELECT CAST(page_id AS VARCHAR) AS path, concat_ws(chr(10), title, 'https://en.wikipedia.org' || path,
      trim(CASE WHEN page_id % 3 = 0 THEN 'DELETED ' ELSE '' END || CASE WHEN page_id % 4 = 0 THEN 'REDIRECT' ELSE '' END),
      '', 'Article', page_id) || coalesce(lines, '') AS card FROM p LEFT JOIN g ON g.src = page_id""",
)
def page_card(spark, sf_dir):
    """Titles of neighbours stand on the card."""
    pages = raw_pages(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("path"), "title", F.col("path").alias("where"), F.lit("").alias("description"), F.lit("Article").alias("article_type"),
        F.col("page_id").alias("unique_id"), (F.col("page_id") % 3 == 0).alias("is_removed"), (F.col("page_id") % 4 == 0).alias("is_redirect"),
    )
    return report.shared_card(*_shared_lines(spark, sf_dir, pages), "group", fn.page_url(F.col("where")))


@query("locale_ops", "SELECT doc_id, 'en,' || 'xx' || lang AS names, '/wiki/' || doc_id AS own, '/en/' || doc_id AS english FROM documents WHERE lang IS NOT NULL")
def locale_ops(spark, sf_dir):
    """A map of one language gains English; languages and paths are read back."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", F.concat(F.lit("xx"), "lang").alias("lang"))
    key = F.col("doc_id").cast("string")
    locales = fn.with_locale(F.create_map("lang", F.concat(F.lit("/wiki/"), key)), "en", F.concat(F.lit("/en/"), key))
    return docs.select("doc_id", F.array_join(fn.locale_names(locales), ",").alias("names"), locales[F.col("lang")].alias("own"), fn.locale_path(locales).alias("english"))

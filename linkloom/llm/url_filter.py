"""URL filter: host rules first, then a blocked Bloom filter with an exact join behind it.

Everything is built from DataFrame functions. The filter is a table of 256-bit
blocks (four longs); a listed URL sets one bit in each of the eight 32-bit lanes
of its block. Pages meet the blocks by block number, and only rows whose eight
bits are all set go on to the exact hash join with the list, which removes the
false positives. The filter never has more than ``MOST_BLOCKS`` blocks, so it is
always broadcast and pages that it stops are never shuffled; a list too long for it
fills it more, and more pages go on to the exact join, with the same result.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no
rule and no canonical form, and is allowed. Very long URLs are judged whole. Of
rules of equal length the one that stands later in the table wins. Empty tables give
empty results. Repeated rows are judged one by one. An empty list allows all that
no rule blocks. Columns other than the id and the URL are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from linkloom.llm.common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (host, path prefix, action); a rule holds for its host and every subdomain.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
BITS_PER_URL = 16
BLOCK_BITS = 256
#: Blocks of the filter at most (32 bytes each, 16 MB): 8 million URLs at 16 bits each.
MOST_BLOCKS = 1 << 19
#: URLs and bytes of a list up to which it is broadcast to the exact join as well.
SMALL_LIST, SMALL_BYTES = 100_000, 8_000_000
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, URL_PARTS, 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host in lower case, path without closing slashes, query without tracking fields; null where there is no host."""
    query = F.regexp_replace(F.regexp_extract(url, URL_PARTS, 3), r"(^|&)(utm_[^&]*|ref=[^&]*)", "")
    query = F.regexp_replace(query, r"^&+", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    whole = F.concat(url_host(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url_host(url) != "", whole)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as text, its action), both null where none fits; the longest rule wins.

    ``rules`` is compiled into the projection, so keep it to hundreds of entries;
    long lists belong in the listed URLs.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def _lanes(key: str, n_blocks: int) -> dict[str, Column]:
    """Block number and the four masks of a URL."""
    lane = lambda i: f"cast(shiftrightunsigned(h, {5 * i}) & 31 as int)"
    masks = {f"m{j}": f"shiftleft(1L, {lane(2 * j)}) | shiftleft(1L, 32 + {lane(2 * j + 1)})" for j in range(4)}
    return {
        "block": F.expr(f"pmod(xxhash64({key}), {n_blocks}L)"),
        **{k: F.expr(v.replace("(h,", f"(xxhash64('lane', {key}),")) for k, v in masks.items()},
    }


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as a table (block, w0..w3) from the column ``canonical``."""
    bits = listed.select(*[c.alias(n) for n, c in _lanes("canonical", n_blocks).items()])
    return bits.groupBy("block").agg(*[F.bit_or(f"m{j}").alias(f"w{j}") for j in range(4)])


def listed_hits(rows: DataFrame, listed: DataFrame, n_listed: int, n_bytes: int | None = None) -> DataFrame:
    """``rows`` (with a column ``canonical``) plus ``listed`` boolean.

    ``listed`` holds distinct non-null canonical URLs, ``n_listed`` of them with
    ``n_bytes`` bytes together. A small list meets the rows in the scan that tests
    them. Otherwise rows that pass the filter go to the exact join and the others
    past it, so only the former are shuffled; rows are then scanned for each branch.
    """
    n_blocks = 1
    while n_blocks < MOST_BLOCKS and n_blocks * BLOCK_BITS < n_listed * BITS_PER_URL:
        n_blocks *= 2
    lanes = _lanes("canonical", n_blocks)
    names = rows.columns
    tested = rows.withColumns({"block": F.when(F.col("canonical").isNotNull(), lanes.pop("block"))})
    tested = tested.join(F.broadcast(bloom_blocks(listed, n_blocks)), "block", "left")  # MOST_BLOCKS rows at most
    every = F.lit(True)
    for j, (_, mask) in enumerate(lanes.items()):
        every = every & (F.col(f"w{j}").bitwiseAND(mask) == mask)
    tested = tested.select(*names, F.coalesce(every, F.lit(False)).alias("possible"))
    exact = listed.select(F.col("canonical").alias("__listed"))
    if n_listed <= SMALL_LIST and n_bytes is not None and n_bytes <= SMALL_BYTES:
        hits = tested.join(F.broadcast(exact), F.col("possible") & (F.col("canonical") == F.col("__listed")), "left")
        return hits.select(*names, F.col("__listed").isNotNull().alias("listed"))
    hits = tested.where("possible").join(exact, F.col("canonical") == F.col("__listed"), "left")
    hits = hits.select(*names, F.col("__listed").isNotNull().alias("listed"))
    rest = tested.where("not possible").select(*names, F.lit(False).alias("listed"))
    return rest.unionByName(hits)


def mirrored_urls(pages: DataFrame, least: int = 2, url: str = "url") -> DataFrame:
    """The list that the query uses: canonical URLs that at least so many pages claim."""
    seen = pages.select(canonical_url(F.col(url)).alias("canonical")).where("canonical is not null")
    return seen.groupBy("canonical").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("canonical")


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule, listed, verdict.

    ``listed`` has a column ``canonical``; nulls and repeats in it count once or not at all.
    """
    counted = Observation()
    listed = listed.select("canonical").where("canonical is not null").distinct()
    # written once: the filter and the exact join read the list, not what it was made from
    listed = written(listed.observe(counted, F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0)).alias("bytes")), "listed")
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(url).alias("host"),
        url_path(url).alias("path"),
        canonical_url(url).alias("canonical"),
    )
    judged = listed_hits(parts, listed, counted.get["n"], counted.get["bytes"])
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, mirrored_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2), '') AS path,
         regexp_replace(regexp_replace(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), ''),
                  '(^|&)(utm_[^&]*|ref=[^&]*)', '', 'g'), '^&+', '') AS kept
  FROM pages
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '')
                 || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT canonical FROM canon WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) >= 2
), ruled AS (
  SELECT c.*, l.canonical IS NOT NULL AS hit,
    CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM canon c LEFT JOIN listed l USING (canonical)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN hit THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

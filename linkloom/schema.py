"""Schemas of the page graph."""

from __future__ import annotations

from pyspark.sql import types as T

from linkloom.functions.meter import TIMES

S, L, B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A vertex; ``path`` is its identity.
PAGES = _struct(path=S, unique_id=L, title=S, description=S, is_redirect=B, article_type=S, is_removed=B, locales=T.MapType(S, S))
#: Crawl state of a link; ``last_processed_ms`` is -1 before the first time.
LINKS = _struct(path=S, link_id=S, processed=B, registered=B, page_found=B, last_processed_ms=L)
#: A link as a page states it, whether or not its target is known.
RAW_LINKS = _struct(src_path=S, dst_path=S)
#: A directed edge between known pages.
EDGES = _struct(src=S, dst=S)
#: A link's paths in all languages; of several writers the last counts.
URLS = _struct(path=S, locales=T.MapType(S, S))
#: The title index: a path has a title while its ``n`` add up to more than 0.
TITLES = _struct(title=S, path=S, n=L)
#: Links that wait for their target's page, by target, counted in the same way.
WAITING = _struct(dst_path=S, src_path=S, n=L)
#: The crawl's log: one row per visit of a link, with the times of its analysis and, where the source tells them, of its fetch.
VISITS = _struct(path=S, generation=L, route=S, error=S, action=S, at_ms=L, worker=L, took_us=L, starved_us=L, blocked_us=L, fetch=TIMES)
FETCHES = _struct(path=S, html=S, status=S)
FIXTURES = _struct(name=S, title=S, description=S, links=T.ArrayType(S))
#: What parsing one fetched document yields; ``error`` is null for a page, ``route`` says where the row goes.
PARSED = _struct(
    path=S, title=S, description=S, is_redirect=B, article_type=S, locales=T.MapType(S, S), links=T.ArrayType(S), error=S, route=S, worker=T.IntegerType(), took_us=L, starved_us=L, blocked_us=L
)

SUCCESS, CONNECTION_ERROR, DOES_NOT_EXIST = "SUCCESS", "CONNECTION_ERROR", "DOES_NOT_EXIST"
NEVER = -1
#: Between two visits of a link, in milliseconds.
DEFAULT_TTL_MS = 100_000

"""Small page graphs as text files: a title, a description, one anchor per link."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.scratch import qualified
from linkloom.sources.fetch import text_files


def read_fixtures(spark, folder: str) -> DataFrame:
    """(name, title, description, links) of every file; links are paths."""
    files = text_files(spark, folder)
    part = lambda tag: F.regexp_extract("html", rf'(?s)<p id\s*=\s*"{tag}"\s*>(.*?)</p>', 1)
    names = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?s)<a>(.*?)</a>"), 1))
    return files.select("name", part("title").alias("title"), part("description").alias("description"), F.transform(names, lambda n: F.concat(F.lit("/wiki/"), n)).alias("links"))


def fixture_text(title: Column, description: Column, links: Column) -> Column:
    """A file's text; an empty or null description has no line."""
    name = lambda p: F.regexp_replace(p, "^/wiki/", "")
    head = F.concat(F.lit('<p id = "title">'), title, F.lit("</p>\n"))
    middle = F.when(F.length(description) > 0, F.concat(F.lit('<p id = "description">'), description, F.lit("</p>\n"))).otherwise("")
    tail = F.array_join(F.transform(links, lambda p: F.concat(F.lit("<a>"), name(p), F.lit("</a>\n"))), "")
    return F.concat(head, middle, tail)


def as_pages(fixtures: DataFrame) -> DataFrame:
    """(name, html) for a TableSource."""
    return fixtures.select("name", fixture_text(F.col("title"), F.col("description"), F.col("links")).alias("html"))


def write_fixtures(fixtures: DataFrame, folder: str) -> None:
    """One text file per page, as ``write_pages`` writes them."""
    write_pages(as_pages(fixtures), folder)


def write_pages(pages: DataFrame, folder: str) -> None:
    """One text file per row (name, html), named ``<name>.txt``, each written where its row lies.

    A file gets its name once it is whole, so a task that runs again, or twice at once,
    leaves the same files. Of rows of equal name any one stays; a page without
    text is an empty file.
    """
    folder = qualified(pages.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                part = f"{root}/_{uuid.uuid4().hex}"
                with files.open_output_stream(part) as out:
                    out.write((text or "").encode())
                files.move(part, f"{root}/{name}.txt")
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    pages.select("name", "html").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def retitled(fixtures: DataFrame, titles: DataFrame) -> DataFrame:
    """With other titles, by name; ``titles`` has name and title."""
    return _changed(fixtures, titles, "title")


def redescribed(fixtures: DataFrame, descriptions: DataFrame) -> DataFrame:
    """With other descriptions, by name."""
    return _changed(fixtures, descriptions, "description")


def _changed(fixtures: DataFrame, new: DataFrame, column: str) -> DataFrame:
    joined = fixtures.join(new.select("name", F.col(column).alias("__new")), "name", "left")
    return joined.withColumn(column, F.coalesce("__new", column)).select(*fixtures.columns)


def with_links(fixtures: DataFrame, links: DataFrame) -> DataFrame:
    """With further links (name, link); one that is there already stays single."""
    more = links.groupBy("name").agg(F.collect_set("link").alias("__more"))
    joined = fixtures.join(more, "name", "left")
    return joined.withColumn("links", F.array_union("links", F.coalesce("__more", F.array().cast("array<string>")))).select(*fixtures.columns)


def without_links(fixtures: DataFrame, links: DataFrame) -> DataFrame:
    """Without the given links (name, link)."""
    fewer = links.groupBy("name").agg(F.collect_set("link").alias("__fewer"))
    joined = fixtures.join(fewer, "name", "left")
    return joined.withColumn("links", F.array_except("links", F.coalesce("__fewer", F.array().cast("array<string>")))).select(*fixtures.columns)

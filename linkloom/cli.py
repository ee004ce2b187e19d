"""Command line: ``wiki``, ``crawler`` and ``exit``, one by one or in a loop."""

from __future__ import annotations

import argparse
import shlex
import sys
from collections.abc import Callable

from pyspark.sql import functions as F

from linkloom.functions.links import normalised_title, page_url, url_path
from linkloom.operators import crawl as crawling
from linkloom.operators import report
from linkloom.operators.paths import path_chain
from linkloom.operators.services import Links, Pages
from linkloom.operators.store import GraphStore
from linkloom.sources.fetch import FileSource, WebSource

SEED = "https://en.wikipedia.org/wiki/Black_hole"
OPTIONS = {"wiki": ["-p", "--path"], "crawler": ["start", "stop", "wait", "--start-link", "-d", "--display"], "exit": []}


class Verbs:
    """Commands by name: found in any case, listed as they were registered."""

    def __init__(self):
        self._verbs: dict[str, tuple[Callable, list[str]]] = {}

    def register(self, name: str, action: Callable, options: list[str] | None = None) -> None:
        self._verbs[name.lower()] = (action, list(options or []))

    def remove(self, name: str) -> None:
        self._verbs.pop(name.lower(), None)

    def find(self, name: str) -> Callable | None:
        return self._verbs.get(name.lower(), (None, []))[0]

    def has(self, name: str) -> bool:
        """Whether a command has exactly this name."""
        return name in self._verbs

    def names(self) -> list[str]:
        return list(self._verbs)

    def completions(self, words: list[str]) -> list[str]:
        """What the last word may become: a command, or an option of the command."""
        last = words[-1] if words else ""
        pool = self.names() if len(words) < 2 else self._verbs.get(words[0].lower(), (None, []))[1]
        return [c for c in pool if c.startswith(last)]


def completions(words: list[str]) -> list[str]:
    verbs = Verbs()
    for name, options in OPTIONS.items():
        verbs.register(name, print, options)
    return verbs.completions(words)


class Shell:
    """The three verbs over one store; ``source`` and ``config`` are those of the crawls it starts."""

    def __init__(self, spark, folder: str, source=None, config: crawling.CrawlConfig | None = None, out=sys.stdout):
        self.spark, self.store, self.out = spark, GraphStore(spark, folder), out
        self.pages, self.source, self.config = Pages(self.store), source or WebSource(), config or crawling.CrawlConfig()
        self.links = Links(self.store, self.config.ttl_ms)
        self.crawl: crawling.Crawler | None = None
        self.running, self.verbs = True, Verbs()
        for name, options in OPTIONS.items():
            self.verbs.register(name, getattr(self, name), options)

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def run(self, line: str) -> None:
        words = shlex.split(line)
        if not words:
            return
        verb = self.verbs.find(words[0])
        if verb is None:
            self.say(f"Unknown command {words[0]}")
            return
        try:
            verb(words[1:])
        except SystemExit:
            pass  # argparse has said why

    def wiki(self, args: list[str]) -> None:
        """No title: the whole graph. Titles: each page. With -p: shortest paths from each to the next."""
        parser = argparse.ArgumentParser(prog="wiki")
        parser.add_argument("titles", nargs="*")
        parser.add_argument("-p", "--path", action="store_true")
        given = parser.parse_args(args)
        pages, edges = self.pages.all(), self.store.read("edges")
        if not given.titles:
            for row in report.adjacency_listing(pages, edges).orderBy("path").toLocalIterator():
                self.say(row.listing)
            return
        asked = self.spark.createDataFrame(list(enumerate(given.titles)), "position long, title string")
        asked = asked.select("position", normalised_title(F.col("title")).alias("title"))
        found = self.pages.by_titles(asked).orderBy("position").collect()  # one row per argument
        if not found:
            self.say("A page was not found")
        elif not given.path:
            cards = report.page_card(pages, edges, page_url(F.col("path")))
            for row in found:
                for card in cards.where(F.col("path") == row.path).collect():
                    self.say(card.card)
        elif len(found) < 2:
            self.say("A path needs two titles at least")
        else:
            legs = path_chain(edges, [r.path for r in found], pages.where("is_removed").select("path"))
            lines = report.titled_paths(legs, pages).select("leg", report.path_text(F.col("path")).alias("line"))
            shown: dict[int, list[str]] = {}
            for row in lines.orderBy("leg", "line").toLocalIterator():
                shown.setdefault(row.leg, []).append(row.line)
            for leg, (a, b) in enumerate(zip(found, found[1:])):
                for line in shown.get(leg, [f"No path exists between {a.title} and {b.title}"]):
                    self.say(line)

    def crawler(self, args: list[str]) -> None:
        """``start`` begins a crawl beside the shell, ``stop`` ends it between two generations, ``wait`` lets it end."""
        parser = argparse.ArgumentParser(prog="crawler")
        parser.add_argument("action", choices=["start", "stop", "wait"])
        parser.add_argument("--start-link", default=SEED)
        parser.add_argument("-d", "--display", action="store_true")
        given = parser.parse_args(args)
        if given.action == "start":
            if self.crawl is not None and self.crawl.running:
                self.say("A crawl is running")
                return
            seeds = self.spark.createDataFrame([(given.start_link,)], "url string").select(url_path(F.col("url")).alias("path"))
            self.crawl = crawling.Crawler(self.store, self.source, self.config)
            self.crawl.start(seeds)
            self.say(f"Crawl from {given.start_link}")
            return
        if given.action == "stop" and self.crawl is not None:
            self.crawl.stop()
        self.wait()
        if given.display:
            self.wiki([])

    def wait(self) -> None:
        """Until the crawl that runs has ended; says what it did."""
        if self.crawl is None:
            return
        crawl, self.crawl = self.crawl, None
        done = crawl.wait()
        self.say(f"{done.indexed} pages in {done.generations} generations, {done.gone} gone, {done.stashed} to try again ({done.ended})")

    def exit(self, args: list[str]) -> None:
        if self.crawl is not None:
            self.crawl.stop()
            self.wait()
        self.running = False

    def loop(self, lines) -> None:
        for line in lines:
            try:
                self.run(line)
            except Exception as e:  # noqa: BLE001  the loop goes on
                self.say(f"{type(e).__name__}: {e}")
            if not self.running:
                return


def main(argv: list[str] | None = None) -> int:
    from linkloom.session import local_session

    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--store", required=True, help="folder of the graph store")
    parser.add_argument("--files", help="fetch pages from <name>.txt files of a folder instead of the web")
    parser.add_argument("command", nargs=argparse.REMAINDER, help="one command; none: read commands line by line")
    given = parser.parse_args(argv)
    shell = Shell(local_session("*"), given.store, FileSource(given.files) if given.files else None)
    shell.loop([shlex.join(given.command)] if given.command else sys.stdin)
    shell.wait()
    return 0


if __name__ == "__main__":
    sys.exit(main())

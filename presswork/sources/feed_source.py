"""Feeds as a source of Spark's own kind: spark.read.format("presswork_feeds") and spark.readStream (S3).

Option feeds: a list file, name and address a line with a tab between them; blank lines and those with # first are skipped.
Each feed is a partition and is read by a task; addresses are files here, since nothing reaches a network. A row is an item,
oldest first: source, title, link, published (null if the feed has no readable date) and error. A feed that can't be read is
one row with the error and doesn't keep the others from being read; a stream leaves it out and comes back to it.

A stream's offset is how many items of each feed have been read, so after a restart it takes up where it ended. Feeds grow at
their newest end; of one that has become shorter nothing is read until it is longer than it was.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urlparse
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source string, title string, link string, published timestamp, error string"


def listed(path: str) -> list[tuple[str, str]]:
    with open(urlparse(path).path, encoding="utf-8") as f:
        lines = [line.strip() for line in f]
    pairs = [line.partition("\t") for line in lines if line and not line.startswith("#")]
    if bad := [a for a, tab, _ in pairs if not tab]:
        raise ValueError(f"no tab in {bad[0]!r}")
    return [(name.strip(), url.strip()) for name, _, url in pairs]


def _date(text: str | None) -> datetime | None:
    if not text:
        return None
    for read in (parsedate_to_datetime, datetime.fromisoformat):
        try:
            at = read(text.strip())
        except (ValueError, TypeError):
            continue
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return None


def items(url: str) -> list[tuple]:
    """title, link, published of a feed's items, oldest first."""
    found = []
    for _, node in ElementTree.iterparse(urlparse(url).path):
        if node.tag.rpartition("}")[2] in ("item", "entry"):
            own = {c.tag.rpartition("}")[2]: (c.text or c.get("href") or "").strip() for c in node}
            found.append((own.get("title"), own.get("link"), _date(own.get("pubDate") or own.get("published") or own.get("updated"))))
            node.clear()
    return found[::-1]


class Feed(InputPartition):
    def __init__(self, name: str, url: str, start: int = 0, end: int | None = None) -> None:
        self.name, self.url, self.start, self.end = name, url, start, end


def _rows(feed: Feed) -> Iterator[tuple]:
    try:
        found = items(feed.url)
    except (OSError, ElementTree.ParseError) as error:
        if feed.end is not None:  # a stream was told how many there are
            raise
        yield feed.name, None, None, None, f"{type(error).__name__}: {error}"
        return
    for item in found[feed.start : feed.end]:
        yield feed.name, *item, None


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Feed]:
        return [Feed(name, url) for name, url in listed(self.path)]

    def read(self, partition: Feed) -> Iterator[tuple]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        counts = {}
        for name, url in listed(self.path):
            try:
                counts[f"{name}\t{url}"] = len(items(url))
            except (OSError, ElementTree.ParseError):
                continue
        return {"read": json.dumps(counts, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        before, after = json.loads(start["read"]), json.loads(end["read"])
        return [Feed(*feed.split("\t", 1), before.get(feed, 0), n) for feed, n in after.items() if n > before.get(feed, 0)]

    def read(self, partition: Feed) -> Iterator[tuple]:
        return _rows(partition)


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "presswork_feeds"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if "feeds" not in self.options:
            raise ValueError("name the list of feeds: option('feeds', path)")
        return self.options["feeds"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self._path())

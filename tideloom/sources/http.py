"""A paged JSON interface as a Spark data source, batch and streaming.

Options: ``url`` (base), ``endpoint`` (posts), ``page`` (rows per request), ``partitions`` (each reads every n-th page),
``paging`` (offset or page).  Pages are read until one is empty or the interface says that no more follow.  ``fetch`` names a function ``module:name`` from (url) to the decoded
answer or None; the default asks by urllib.  Rows are JSON texts with their id, parsed by :mod:`.archive`.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "id string, comment_count long, body string"


def ask(url: str, tries: int = 4, wait: float = 1.0) -> dict | list | None:
    """The decoded answer; busy or failing servers are asked again after waits that double.  A missing page is None."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:  # noqa: S310
                return json.load(answer)
        except urllib.error.HTTPError as error:
            if error.code == 404:
                return None
            if attempt + 1 == tries or error.code not in (429, 500, 502, 503, 504):
                raise
        except urllib.error.URLError:
            if attempt + 1 == tries:
                raise
        time.sleep(wait * 2**attempt)
    return None


def _fetcher(options: dict) -> Callable[[str], dict | list | None]:
    if name := options.get("fetch"):
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)
    return ask


def rows_of(answer: dict | list | None, endpoint: str) -> list[dict]:
    """The items of an answer: a bare list, or an object with the endpoint's name or ``data``."""
    if isinstance(answer, list):
        return answer
    return (answer or {}).get(endpoint) or (answer or {}).get("data") or []


def as_row(item: dict) -> tuple:
    return str(item.get("id")), int(item.get("comment_count") or 0), json.dumps(item, ensure_ascii=False)


class Pages(InputPartition):
    def __init__(self, first: int, step: int):
        super().__init__((first, step))
        self.first, self.step = first, step


class PagedSource(DataSource):
    """``spark.read.format("paged_json")`` and ``spark.readStream.format("paged_json")``."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return NewestFirst(dict(self.options))


def _url(options: dict, page: int) -> str:
    size = int(options.get("page", 25))
    endpoint = options.get("endpoint", "posts")
    where = f"page={page + 1}" if options.get("paging") == "page" else f"offset={page * size}"
    return f"{options['url'].rstrip('/')}/{endpoint}?sort=new&limit={size}&{where}"


def is_last(payload: list | dict | None) -> bool:
    """True if the interface says that no page follows."""
    return isinstance(payload, dict) and payload.get("has_more") is False


class PagedReader(DataSourceReader):
    """Each partition reads pages first, first + n, ... until one is empty."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Pages]:
        n = int(self.options.get("partitions", 1))
        return [Pages(i, n) for i in range(n)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch, page = _fetcher(self.options), partition.first
        while True:
            payload = fetch(_url(self.options, page))
            items = rows_of(payload, self.options.get("endpoint", "posts"))
            if not items:
                return
            yield from map(as_row, items)
            if is_last(payload):
                return
            page += partition.step


class NewestFirst(SimpleDataSourceStreamReader):
    """Polls the newest pages and stops after three known ids in a row; the offset is the newest id seen."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"known": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        fetch, known = _fetcher(self.options), set(start["known"])
        fresh, page, seen = [], 0, 0
        while seen < 3:
            payload = fetch(_url(self.options, page))
            items = rows_of(payload, self.options.get("endpoint", "posts"))
            if not items:
                break
            for item in items:
                if str(item.get("id")) in known:
                    seen += 1
                    if seen >= 3:
                        break
                else:
                    seen = 0
                    fresh.append(as_row(item))
            page += 1
            if is_last(payload):
                break
        # the newest ids are enough to know where the last poll began: polls go from the newest on and stop at three of them;
        # should fewer of these still exist, older items come again, which a table kept by id takes in
        newest = ([r[0] for r in fresh] + list(start["known"]))[:1000]
        return iter(fresh), {"known": newest}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        wanted = set(end["known"]) - set(start["known"])
        rows, _ = self.read(start)
        return iter([r for r in rows if r[0] in wanted])


def register(spark) -> None:
    spark.dataSource.register(PagedSource)

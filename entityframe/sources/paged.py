"""A paged web API as a Spark data source: pages are partitions, so executors fetch them side by side.

Options: url with {page}, {offset} and {limit}; pages; limit; wrapped (a key that holds the rows, none for a bare list).
Fetching is a function from a URL to text, so that tests need no network.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Retries after a failure, and seconds before the first and at most before any (fixed values).
RETRIES, FIRST_WAIT, MOST_WAIT = 4, 0.05, 10.0


def http_get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
        return r.read().decode()


def patient(fetch: Callable[[str], str], url: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """Tries again after doubling waits with up to a quarter more at random."""
    wait = FIRST_WAIT
    for left in range(RETRIES, -1, -1):
        try:
            return fetch(url)
        except OSError as error:
            # a refusal of the request itself stays one, but for time-outs and rate limits
            refused = 400 <= getattr(error, "code", 0) < 500 and error.code not in (408, 429)
            if refused or not left:
                raise
            sleep(min(wait, MOST_WAIT) * (1 + random.random() / 4))
            wait *= 2
    raise AssertionError


def rows_of(text: str, wrapped: str | None) -> list[dict]:
    """A bare array, or the array under a key; without a key, the only array of an object."""
    data = json.loads(text)
    if wrapped:
        for key in wrapped.split("."):
            data = data[key]
    elif isinstance(data, dict):
        lists = [v for v in data.values() if isinstance(v, list)]
        if len(lists) != 1:
            raise ValueError("name the key of the rows with the option wrapped")
        data = lists[0]
    return data


def at_path(row: dict, path: str):
    """A literal key first, else the value at a dotted path."""
    if path in row:
        return row[path]
    for key in path.split("."):
        row = row.get(key) if isinstance(row, dict) else None
    return row


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema, fetch: Callable[[str], str]):
        self.options, self.schema, self.fetch = options, schema, fetch

    def partitions(self):
        """With the number of pages known, a task for each; else one task that reads on to the last page."""
        pages = self.options.get("pages")
        return [InputPartition(i) for i in range(int(pages))] if pages else [InputPartition(None)]

    def page(self, number: int, limit: int) -> list[dict]:
        url = self.options["url"].format(page=number + 1, offset=number * limit, limit=limit)
        return rows_of(patient(self.fetch, url), self.options.get("wrapped"))

    def read(self, partition):
        limit, number = int(self.options.get("limit", 50)), partition.value or 0
        while True:
            rows = self.page(number, limit)
            for row in rows:
                yield tuple(at_path(row, f.name) for f in self.schema.fields)
            if partition.value is not None or len(rows) < limit:  # a short page is the last
                return
            number += 1
            time.sleep(float(self.options.get("pause", 0)))


class PagedSource(DataSource):
    fetch: Callable[[str], str] = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("give the schema with .schema(...)")

    def reader(self, schema):
        return PagedReader(self.options, schema, type(self).fetch)


def selection(paths: list[str]) -> str:
    """Dotted columns as a nested selection: `id`, `author.name` give `id author { name }`."""
    own, nested = [], {}
    for path in paths:
        head, _, rest = path.partition(".")
        if rest:
            nested.setdefault(head, []).append(rest)
        else:
            own.append(head)
    return " ".join(own + [f"{k} {{ {selection(v)} }}" for k, v in nested.items()])


def http_post(url: str) -> str:
    """url and body with a line break between them."""
    at, _, body = url.partition("\n")
    request = urllib.request.Request(at, body.encode(), {"Content-Type": "application/json"})  # noqa: S310
    with urllib.request.urlopen(request, timeout=30) as r:  # noqa: S310
        return r.read().decode()


class GraphReader(PagedReader):
    def page(self, number: int, limit: int) -> list[dict]:
        root, extra = self.options["root"], self.options.get("arguments")
        arguments = f"limit: {limit}, offset: {number * limit}" + (f", {extra}" if extra else "")
        text = f"{{ {root}({arguments}) {{ {selection([f.name for f in self.schema.fields])} }} }}"
        answer = json.loads(patient(self.fetch, self.options["url"] + "\n" + json.dumps({"query": text})))
        if answer.get("errors"):
            raise ValueError(str(answer["errors"]))
        return rows_of(json.dumps(answer), self.options.get("path", f"data.{root}"))


class GraphSource(PagedSource):
    """A GraphQL table: options url, root, and path of the rows in the answer; columns may be dotted paths."""

    fetch: Callable[[str], str] = staticmethod(http_post)

    @classmethod
    def name(cls) -> str:
        return "paged_graphql"

    def reader(self, schema):
        return GraphReader(self.options, schema, type(self).fetch)

"""Fetching as Spark data sources: numbered pages in batch, and the posts of a board as a stream.

A transport, which the caller injects, gets a page: ``transport(url, params)`` gives bytes or raises.
Workers call it, with retries and back-off; what cannot be got is a row with its error.
"""

import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import attach
from . import boards

#: Tries of a page, seconds of back-off for each try before, and between pages.
TRIES, BACK_OFF, DELAY = 3, 1.5, 0.3
Transport = Callable[[str, dict], bytes]


@dataclass
class Fetcher:
    """Gets pages by a transport."""

    transport: Transport
    tries: int = TRIES
    back_off: float = BACK_OFF
    delay: float = DELAY

    def get(self, url: str, params: dict) -> tuple[str | None, int, str | None]:
        """(text, tries, error): bytes that are no UTF-8 are replaced; after the last try the error is told."""
        for attempt in range(1, self.tries + 1):
            try:
                text = self.transport(url, params).decode("utf-8", "replace")
                time.sleep(self.delay)
                return text, attempt, None
            except Exception as e:  # whatever a transport raises is the page's error, not the job's
                error = f"{type(e).__name__}: {e}"
                if attempt < self.tries:
                    time.sleep(self.back_off * attempt)
        return None, self.tries, error


@dataclass
class Pages(InputPartition):
    """The pages, or posts, of a partition."""

    numbers: Sequence[int]


def _parts(numbers: Sequence[int], each: int) -> list[Pages]:
    return [Pages(numbers[a : a + each]) for a in range(0, len(numbers), each)]


def page_source(transport: Transport, name: str = "fetched_pages", **how) -> type[DataSource]:
    """A data source to register: (page, html, tries, error) of the pages ``first`` to ``last`` of ``url``, each
    asked for by the parameter ``page``; options are url, first (1), last, and each, the pages of a
    partition (1)."""
    fetcher = Fetcher(transport, **how)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.url = options["url"]
            self.numbers = range(int(options.get("first", "1")), int(options["last"]) + 1)
            self.each = int(options.get("each", "1"))

        def partitions(self):
            return _parts(self.numbers, self.each) or [Pages([])]

        def read(self, partition):
            for n in partition.numbers:
                yield (n, *fetcher.get(self.url, {"page": n}))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "page bigint, html string, tries int, error string"

        def reader(self, schema):
            return Reader(self.options)

    return Source


def post_source(transport: Transport, name: str = "board_posts", **how) -> type[DataSource]:
    """A stream source to register: (ntt_sn, html, tries, error) of each post of a board that is newer than what
    the stream has had.

    Its offset is the number of the newest post, so that a restarted stream goes on after the last post
    of the batches that it has committed.  ``url`` lists the board's posts, newest first, by the
    parameter ``page``, and ``post_url`` gives one by ``ntt_sn``; ``after`` is the post before the
    first one wanted (0), ``each`` the posts of a partition (1).  Lists are read until a page
    has nothing new; where they cannot be got, the batch fails and is tried again by the restarted stream."""
    fetcher = Fetcher(transport, **how)

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            self.url, self.post_url = options["url"], options.get("post_url", options["url"])
            self.after, self.each = int(options.get("after", "0")), int(options.get("each", "1"))

        def _listed(self, page: int) -> list[int]:
            html, _, error = fetcher.get(self.url, {"page": page})
            if error:
                raise RuntimeError(f"list page {page}: {error}")
            return [int(n) for n in re.findall(boards.POST_LINK, html)]

        def initialOffset(self):  # noqa: N802
            return {"post": self.after}

        def latestOffset(self):  # noqa: N802
            return {"post": max(self._listed(1), default=self.after)}

        def partitions(self, start, end):
            posts, page = set(), 1
            while start["post"] < end["post"]:
                listed = self._listed(page)
                new = {n for n in listed if start["post"] < n <= end["post"]}
                if not listed or (max(listed) <= start["post"]) or (not new and min(listed) <= end["post"]):
                    break
                posts |= new
                page += 1
            return _parts(sorted(posts), self.each) or [Pages([])]

        def read(self, partition):
            for n in partition.numbers:
                yield (n, *fetcher.get(self.post_url, {"ntt_sn": n}))

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "ntt_sn bigint, html string, tries int, error string"

        def streamReader(self, schema):  # noqa: N802
            return Reader(self.options)

    return Source


#: Pages of a stored block, which a worker reads at once.
BLOCK = 512


def stored_pages(pages: DataFrame, path: str, key: str, column: str, block: int = BLOCK) -> "TableTransport":
    """A transport that serves the rows of a table, by a copy at ``path`` in blocks of pages by their numbers."""
    attach(pages.sparkSession)
    rows = pages.where(F.col(key).isNotNull()).select(key, column, F.floor(F.col(key) / block).alias("block"))
    rows.repartition("block").write.partitionBy("block").parquet(path)
    return TableTransport(path, key, column, block)


class TableTransport:
    """A transport that serves a stored table's rows instead of a site: the page asked for is the row of that
    number.  A worker reads the block of the page that it is asked for, and keeps it for the pages after it."""

    def __init__(self, path: str, key: str, column: str, block: int = BLOCK):
        self.path, self.key, self.column, self.block = path, key, column, block
        self.held, self.rows = None, {}

    def _block(self, number: int) -> dict:
        import pyarrow.dataset as ds
        from pyarrow import fs

        if self.held != number:
            system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
            folder = f"{path}/block={number}"
            there = system.get_file_info(folder).type == fs.FileType.Directory
            table = ds.dataset(folder, filesystem=system, format="parquet").to_table([self.key, self.column]) if there else None
            self.held, self.rows = number, dict(zip(*(table[c].to_pylist() for c in (self.key, self.column)), strict=True)) if there else {}
        return self.rows

    def __call__(self, url: str, params: dict) -> bytes:
        found = self._block(params["page"] // self.block).get(params["page"])
        if found is None:
            raise LookupError(f"no page {params['page']}")
        return found.encode()

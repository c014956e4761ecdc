"""A data source of pages by id: ``spark.read.format("pages_by_id")``.

Options: ``start`` (highest id), ``back`` (how many ids downward), ``url`` (with {id}), ``delay`` (seconds between requests of a
task), ``tasks`` (parallel requests, few on purpose), ``agent`` (who asks). Ids that fail are left out. A ``file:`` address reads from a folder, so the source works without a network.
An early stop is a ``limit`` on what is read.

As a stream, ``spark.readStream.format("pages_by_id")``, an id is due every ``pace`` seconds from ``since`` on (seconds of the epoch, the same for all runs of a crawl), so the address is asked no
faster than that however many tasks there are, and a micro-batch takes what has fallen due. The offset is how many ids are done. It stands in the stream's checkpoint: a crawl that stops goes on from
its last whole batch, and with a sink that writes a batch once no page is kept twice or lost.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

AGENT = "folioflow/0.1"


class IdRange(InputPartition):
    def __init__(self, ids: list[int]):
        self.ids = ids


def fetch(url: str, agent: str, timeout: float = 30.0) -> bytes | None:
    """The body behind an address, null where it can't be had."""
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.read()
    except (urllib.error.URLError, TimeoutError, OSError):
        return None


class PagesById(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages_by_id"

    def schema(self) -> str:
        return "rbi_id bigint, source_url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url = options["url"]
        self.start, self.back = int(options["start"]), int(options.get("back", "700"))
        self.delay, self.tasks = float(options.get("delay", "0.4")), int(options.get("tasks", "3"))
        self.agent = options.get("agent", AGENT)

    def dealt(self, ids: range) -> list[IdRange]:
        return [IdRange(list(ids[i :: self.tasks])) for i in range(self.tasks) if ids[i :: self.tasks]]

    def partitions(self) -> list[IdRange]:
        return self.dealt(range(self.start, self.start - self.back, -1))

    def read(self, partition: IdRange) -> Iterator[tuple]:
        for i in partition.ids:
            url = self.url.replace("{id}", str(i))
            body = fetch(url, self.agent)
            if body is not None:
                yield i, url, body.decode("utf-8", "replace")
            if self.delay and not url.startswith("file:"):
                time.sleep(self.delay)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.crawl = _Reader(options)
        self.since, self.pace = float(options["since"]), float(options.get("pace", self.crawl.delay))

    def initialOffset(self) -> dict:
        return {"done": 0}

    def latestOffset(self) -> dict:
        return {"done": max(0, min(self.crawl.back, int((time.time() - self.since) / self.pace)))}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        return self.crawl.dealt(range(self.crawl.start - start["done"], self.crawl.start - end["done"], -1))

    def read(self, partition: IdRange) -> Iterator[tuple]:
        return self.crawl.read(partition)

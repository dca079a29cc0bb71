"""Event logs by block range as a Spark data source, batch and stream.

    spark.dataSource.register(BlockLogs)
    spark.read.format("block_logs").options(fetch="module:function", start=0, end=99, chunk=2000).load()

`fetch` names a function (first block, last block) -> rows of (block, log_index,
address, topic, data), or of the `columns` given, which begin with the first
two; the tasks call it, and a third party's client goes there. It raises TooLarge
where a range has more than it can return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = "block LONG, log_index LONG, address STRING, topic STRING, data STRING"
#: Logs with all topics and their transaction.
FULL = "block LONG, log_index LONG, tx STRING, address STRING, topics ARRAY<STRING>, data STRING"


class TooLarge(Exception):
    """A range of blocks whose logs don't fit one answer."""


class Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def function(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def logs(fetch: Callable, first: int, last: int) -> Iterator[tuple]:
    """Rows in block order; a range that is too large is halved, down to one
    block, whose error is passed on."""
    try:
        yield from sorted(fetch(first, last), key=lambda row: row[:2])
    except TooLarge:
        if first == last:
            raise
        middle = (first + last) // 2
        yield from logs(fetch, first, middle)
        yield from logs(fetch, middle + 1, last)


def ranges(first: int, last: int, chunk: int) -> list[Blocks]:
    return [Blocks(a, min(a + chunk - 1, last)) for a in range(first, last + 1, chunk)]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.first, self.last, self.chunk = options["fetch"], int(options.get("start", 0)), int(options["end"]), int(options.get("chunk", 2000))

    def partitions(self) -> list[Blocks]:
        return ranges(self.first, self.last, self.chunk)

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return logs(function(self.fetch), partition.first, partition.last)


class StreamReader(DataSourceStreamReader):
    """Offsets are the next block to read; `head` names a function that gives
    the last block there is."""

    def __init__(self, options: dict):
        self.fetch, self.head, self.start, self.chunk = options["fetch"], options["head"], int(options.get("start", 0)), int(options.get("chunk", 2000))

    def initialOffset(self) -> dict:
        return {"block": self.start}

    def latestOffset(self) -> dict:
        return {"block": max(self.start, function(self.head)() + 1)}

    def partitions(self, start: dict, end: dict) -> list[Blocks]:
        return ranges(start["block"], end["block"] - 1, self.chunk)

    def read(self, partition: Blocks) -> Iterator[tuple]:
        return logs(function(self.fetch), partition.first, partition.last)


class BlockLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_logs"

    def schema(self) -> str:
        return self.options.get("columns", COLUMNS)

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

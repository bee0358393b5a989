"""Crawler plug-ins as a Spark data source: a source is a class with three methods, found by its name.

``spark.read.format("crawl").option("source", name)`` offers three tables (option ``table``): ``chapters``, ``novel_info`` and
``search``. A filter on ``novel`` (or ``words``, in searches) is pushed into the source, so no partition of another novel is
opened; as a stream, chapters arrive by the number that was seen of each novel. Load a table anew for each query: Spark
4.1 keeps what a filter left of a loaded one, also for a later query without that filter.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .files import opened

SOURCES: dict[str, type[Source]] = {}
#: The tables of a source: their columns, and the one by which they are asked.
TABLES = {
    "chapters": ("novel string, place int, title string, url string", "novel"),
    "novel_info": ("novel string, title string, author string", "novel"),
    "search": ("words string, position int, title string, author string", "words"),
}


class Source:
    """What a plug-in offers: a novel's facts, its chapters, a search, and the novels that it has if none are named."""

    name = ""

    def __init_subclass__(cls) -> None:
        SOURCES[cls.name] = cls

    def __init__(self, options: dict[str, str] | None = None):
        self.options = options or {}

    def novels(self) -> list[str]:
        return []

    def novel_info(self, novel: str) -> dict:
        raise NotImplementedError

    def chapters(self, novel: str) -> list[tuple[int, str, str]]:
        raise NotImplementedError

    def search(self, words: str) -> list[dict]:
        raise NotImplementedError


class Example(Source):
    """Answers without a network, for tests."""

    name = "example"

    def novel_info(self, novel: str) -> dict:
        return {"title": f"Novel {novel}", "author": "Example"}

    def chapters(self, novel: str) -> list[tuple[int, str, str]]:
        return [(k, f"Chapter {k}", f"https://example.com/{novel}/{k}.html") for k in range(1, 4)]

    def search(self, words: str) -> list[dict]:
        return [{"title": words, "author": "Example"}]


class Dump(Source):
    """Novels that a crawl stored, a JSON file each: ``{"title", "author", "chapters": [{"title", "url"}]}``; option ``root``."""

    name = "dump"

    def _read(self, novel: str) -> dict:
        system, base = opened(self.options["root"])
        with system.open_input_stream(f"{base}/{novel}.json") as f:
            return json.loads(f.read())

    def novels(self) -> list[str]:
        from pyarrow import fs

        system, base = opened(self.options["root"])
        return sorted(i.base_name.removesuffix(".json") for i in system.get_file_info(fs.FileSelector(base)) if i.base_name.endswith(".json"))

    def novel_info(self, novel: str) -> dict:
        return self._read(novel)

    def chapters(self, novel: str) -> list[tuple[int, str, str]]:
        return [(k, c.get("title"), c.get("url")) for k, c in enumerate(self._read(novel).get("chapters", []), 1)]

    def search(self, words: str) -> list[dict]:
        return [found for n in self.novels() if words in (found := self._read(n)).get("title", "")]


class _Asked(InputPartition):
    def __init__(self, value: str, first: int = 0, last: int | None = None):
        self.value, self.first, self.last = value, first, last


def _rows(source: Source, table: str, asked: _Asked) -> Iterator[tuple]:
    if table == "novel_info":
        facts = source.novel_info(asked.value)
        yield asked.value, facts.get("title"), facts.get("author")
    elif table == "search":
        for k, found in enumerate(source.search(asked.value)):
            yield asked.value, k, found.get("title"), found.get("author")
    else:
        for place, title, url in source.chapters(asked.value)[asked.first : asked.last]:
            yield asked.value, place, title, url


class _Reader(DataSourceReader):
    def __init__(self, source: type[Source], options: dict[str, str], table: str, asked: list[str]):
        self.source, self.options, self.table, self.asked = source, options, table, asked
        self.pushed: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities of the column that the table is asked by; all other filters are Spark's."""
        own = (TABLES[self.table][1],)
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == own else set(f.value) if isinstance(f, In) and f.attribute == own else None
            if wanted is None:
                yield f
            else:
                self.pushed = wanted if self.pushed is None else self.pushed & wanted

    def partitions(self) -> list[InputPartition]:
        asked = self.asked
        if not asked:
            # What a filter names need not be listed first; a search must be asked something.
            asked = sorted(x for x in self.pushed if x is not None) if self.pushed is not None else [] if self.table == "search" else self.source(self.options).novels()
        return [_Asked(x) for x in asked if self.pushed is None or x in self.pushed]

    def read(self, partition: _Asked) -> Iterator[tuple]:
        return _rows(self.source(self.options), self.table, partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    """Chapters of novels as they are added; the offset is how many were seen of each."""

    def __init__(self, source: type[Source], options: dict[str, str], asked: list[str]):
        self.source, self.options, self.asked = source, options, asked

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        source = self.source(self.options)
        return {n: len(source.chapters(n)) for n in self.asked or source.novels()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Asked(n, start.get(n, 0), upto) for n, upto in end.items() if upto > start.get(n, 0)]

    def read(self, partition: _Asked) -> Iterator[tuple]:
        return _rows(self.source(self.options), "chapters", partition)


class Crawl(DataSource):
    """Options: ``source`` (a plug-in's name), ``table``, ``novels`` or ``words`` (separated by commas), and the plug-in's own."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def _table(self) -> str:
        table = self.options.get("table", "chapters")
        if table not in TABLES:
            raise ValueError(f"a source has no table {table!r}; there are {sorted(TABLES)}")
        return table

    def _source(self) -> type[Source]:
        name = self.options.get("source", "")
        if name not in SOURCES:
            raise ValueError(f"no source is called {name!r}; there are {sorted(SOURCES)}")
        return SOURCES[name]

    def schema(self) -> str:
        return TABLES[self._table()][0]

    def _asked(self) -> list[str]:
        return [n for n in self.options.get("words" if self._table() == "search" else "novels", "").split(",") if n]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._source(), dict(self.options), self._table(), self._asked())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self._source(), dict(self.options), self._asked())


class Chapters(Crawl):
    """The same by its older name."""

    @classmethod
    def name(cls) -> str:
        return "chapters"


def register(spark: SparkSession) -> None:
    """Makes the sources known; filters are pushed into them from here on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Crawl)
    spark.dataSource.register(Chapters)

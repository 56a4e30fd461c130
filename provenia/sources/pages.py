"""Pages of files as a Spark source: planned by bytes and page ranges, parsed by a plug-in, faults told as rows."""

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from provenia.operators.stages import workers_find_package
from provenia.sources.sink import opened

NAME = "provenia_pages"
PAGES = "file string, path string, page_no int, text string, width double, height double, rotation int, fault string"
#: Bytes of files that a task gets; a larger file is a task for each SPLIT_PAGES pages, as many as it has times TASK_BYTES, the last without an end.
TASK_BYTES, SPLIT_PAGES = 64 << 20, 500
#: A parser gives the pages of a file from `first` to `last` (None: to its end), numbered from 1: (page_no, text, width, height, rotation).
Parser = Callable[[bytes, int, int | None], Iterator[tuple[int, str | None, float | None, float | None, int | None]]]


def text_pages(content: bytes, first: int, last: int | None) -> Iterator[tuple]:
    """The parser of plain text in UTF-8: a form feed ends a page. A4 in points, upright."""
    parts = content.decode("utf-8").split("\f")
    for i, text in enumerate(parts[first - 1 : last], first):
        yield i, text, 595.0, 842.0, 0


def named(parser: str) -> Parser:
    """The parser that "module:function" names."""
    module, _, name = parser.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Piece:
    path: str
    first: int = 1
    last: int | None = None


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece] = field(default_factory=list)


def planned(files: list[tuple[str, int]], task_bytes: int = TASK_BYTES, split_pages: int = SPLIT_PAGES) -> list[list[Piece]]:
    """Tasks for files (path, bytes): small ones together up to task_bytes, larger ones cut into ranges of pages. Each page lies in exactly one piece."""
    out: list[list[Piece]] = []
    room = -1
    for path, size in sorted(files):
        cuts = -(-size // task_bytes)
        if cuts > 1:
            out += [[Piece(path, 1 + i * split_pages, None if i == cuts - 1 else (i + 1) * split_pages)] for i in range(cuts)]
            room = -1
            continue
        if size > room:
            out.append([])
            room = task_bytes
        out[-1].append(Piece(path))
        room -= size
    return out


class PageReader(DataSourceReader):
    def __init__(self, root: str, pattern: str, parser: str, task_bytes: int, split_pages: int):
        self.root, self.pattern, self.parser, self.task_bytes, self.split_pages = root, pattern, parser, task_bytes, split_pages
        self.least, self.most = 1, None
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of page_no end the parsing early, names of files keep others from being opened. Spark applies them again: a row of a fault has no page
        and would be no page within the bounds either."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("page_no",) and isinstance(f, LessThanOrEqual | LessThan | EqualTo):
                bound = f.value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            if at == ("page_no",) and isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            if at == ("file",) and isinstance(f, EqualTo | In):
                told = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = told if self.names is None else self.names & told
            yield f

    def partitions(self) -> list[Pieces]:
        files, root = opened(self.root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=False))
        found = [(x.path, x.size) for x in found if x.is_file and fnmatchcase(x.base_name, self.pattern) and (self.names is None or x.base_name in self.names)]
        tasks = planned(found, self.task_bytes, self.split_pages)
        wanted = [[p for p in task if (self.most is None or p.first <= self.most) and (p.last is None or p.last >= self.least)] for task in tasks]
        return [Pieces(task) for task in wanted if task] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        parse, (files, _) = named(self.parser), opened(self.root)
        for piece in partition.pieces:
            first = max(piece.first, self.least)
            last = min((x for x in (piece.last, self.most) if x is not None), default=None)
            name = piece.path.rsplit("/", 1)[-1]
            if last is not None and last < first:
                continue
            with files.open_input_file(piece.path) as f:  # a failure to read fails the task, which Spark tries again
                content = f.read()
            try:
                for page_no, text, width, height, rotation in parse(content, first, last):
                    yield name, piece.path, page_no, text, width, height, rotation, None
            except Exception as e:  # what a parser raises is the file's fault: told in a row, once for each piece of the file
                yield name, piece.path, None, None, None, None, None, f"{type(e).__name__}: {e}"


class PageSource(DataSource):
    """spark.read.format("provenia_pages"): options path, parser ("module:function"), pattern, taskBytes, splitPages."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PageReader:
        o = self.options
        if not o.get("path"):
            raise ValueError("path is needed")
        return PageReader(o["path"], o.get("pattern", "*"), o.get("parser", f"{__name__}:text_pages"), int(o.get("taskBytes", TASK_BYTES)), int(o.get("splitPages", SPLIT_PAGES)))


def pages_of_files(spark: SparkSession, root: str, parser: str | None = None, pattern: str = "*", task_bytes: int = TASK_BYTES, split_pages: int = SPLIT_PAGES) -> DataFrame:
    """(file, path, page_no, text, width, height, rotation, fault) of the files below root, read as they are needed.

    A file that the parser can't read is one row, with the fault and without a page; pages that came before the fault stay. A file over task_bytes is parsed in ranges
    of split_pages pages by tasks of their own, each of which reads the file and may tell the fault. Files are listed by the driver. No files give no rows. Filters on page_no and file
    reach the parser and the list.
    """
    workers_find_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    read = spark.read.format(NAME).option("pattern", pattern).option("taskBytes", task_bytes).option("splitPages", split_pages)
    return (read.option("parser", parser) if parser else read).load(root)

"""Files of lines that are still being written: a streaming source that goes on from a byte position of each file, and full reads of files named in a column.

``tailed_lines`` (format of ``spark.readStream`` after ``register``) gives out a line in the micro-batch in which its end arrives:
a partial last line waits, whatever its length, and is then given out whole. Its offset is the size of each file, so a restart goes on where
the last micro-batch ended. What is new in a file is read in ranges of ``RANGE`` bytes by several tasks: a line belongs to the
range that holds its end, and its reader goes back to where the line begins. What is new in many small files is read by one task.

Options: ``path`` (a folder, any that ``pyarrow.fs`` reads), ``suffix`` (of the files' names; all files, if left out).
Columns: session_id (of a folder ``session_id=...``, else the file's name without .jsonl), path, position (of the line's first byte), value.

Defined cases: a missing folder has no files; hidden files (names beginning with . or _) are no files; a file that shrank gives
nothing, and goes on from its new end; bytes that are no UTF-8 become replacement characters; an empty line is a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
OPEN = 256 << 10  # bytes that opening a file counts as: so many small files share a task
CHUNK = 1 << 20
LINES = 4096  # lines of a batch

SCHEMA = "session_id string, path string, position bigint, value string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there; names may hold any characters."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
    if not found or found[1].lower() == "file":
        return pafs.LocalFileSystem(), found[3] if found else path
    system, base = pafs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")
    return system, base.rstrip("/") + found[3]


def session_of(path: str) -> str:
    named = re.search(r"/session_id=([^/]+)/", path)
    return named[1] if named else re.sub(r"\.jsonl$", "", path.rpartition("/")[2])


def _begin_of_line(f, at: int) -> int:
    """Where the line begins that goes on at ``at``."""
    while at > 0:
        size = min(CHUNK, at)
        found = f.read_at(size, at - size).rfind(b"\n")
        if found >= 0:
            return at - size + found + 1
        at -= size
    return 0


def lines_between(path: str, start: int, end: int, last: bool = False) -> Iterator[tuple[int, str]]:
    """Position and text of the lines whose end lies in [start, end) of the file; with ``last`` also of what stands behind the last end."""
    system, own = opened(path)
    with system.open_input_file(own) as f:
        at = begin = _begin_of_line(f, start)
        rest: list[bytes] = []
        while at < end:
            data = f.read_at(min(CHUNK, end - at), at)
            if not data:
                break
            at += len(data)
            *whole, more = data.split(b"\n")
            for x in whole:
                line = b"".join([*rest, x])
                rest = []
                yield begin, line.decode("utf-8", "replace")
                begin += len(line) + 1
            if more:
                rest.append(more)
        if last and rest:
            yield begin, b"".join(rest).decode("utf-8", "replace")


def ranges(start: int, end: int) -> list[tuple[int, int]]:
    return [(a, min(end, a + RANGE)) for a in range(start, end, RANGE)]


class Part(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, own = opened(self.path)
        found = system.get_file_info(pafs.FileSelector(own, recursive=True, allow_not_found=True))
        shown = lambda path: not any(x[:1] in "._" for x in path[len(own) :].strip("/").split("/"))
        return dict(sorted((x.path[len(own) :].strip("/"), x.size) for x in found if x.is_file and x.path.endswith(self.suffix) and shown(x.path)))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts: list[Part] = []
        room = 0
        for path, a, b in ((f"{self.path.rstrip('/')}/{name}", a, b) for name, size in end.items() for a, b in ranges(start.get(name, 0), size)):
            cost = b - a + OPEN
            if not parts or cost > room:
                parts.append(Part([]))
                room = RANGE
            parts[-1].ranges.append((path, a, b))
            room -= cost
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        some: list[tuple[str, str, int, str]] = []

        def batch():
            kinds = {"session_id": pa.string(), "path": pa.string(), "position": pa.int64(), "value": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some), kinds.values())], list(kinds))

        for path, start, end in partition.ranges:
            session = session_of(path)
            for x in lines_between(path, start, end):
                some.append((session, path, *x))
                if len(some) == LINES:
                    yield batch()
                    some = []
        if some:
            yield batch()


class TailedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tailed_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailedLines)


def _sizes(named):
    """(.., path) -> (.., path, start, end, last): the ranges of each file; none of a file that can't be read."""

    def run(batches):
        for b in batches:
            rows = []
            for i, path in enumerate(b.column(b.num_columns - 1).to_pylist()):
                try:
                    system, own = opened(path)
                    info = system.get_file_info(own)
                except (OSError, ValueError, TypeError, pa.ArrowInvalid):
                    continue
                size = info.size if info.is_file else 0
                rows += [(i, a, e, e == size) for a, e in ranges(0, size)]
            if rows:
                at, start, end, last = zip(*rows)
                kept = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(last)], named)

    return run


def _read(named):
    """(.., path, start, end, last) -> (.., position, value)."""

    def run(batches):
        for b in batches:
            keep = b.num_columns - 4
            for i in range(b.num_rows):
                path, start, end, last = (b.column(keep + k)[i].as_py() for k in range(4))
                own = b.slice(i, 1)
                some: list[tuple[int, str]] = []

                def batch(own=own):
                    many = own.take(pa.array([0] * len(some)))
                    return pa.RecordBatch.from_arrays([*many.columns[:keep], pa.array([p for p, _ in some], pa.int64()), pa.array([x for _, x in some], pa.string())], named)

                for x in lines_between(path, start, end, last):
                    some.append(x)
                    if len(some) == LINES:
                        yield batch()
                        some = []
                if some:
                    yield batch()

    return run


def lines_of(files: DataFrame, path: str = "path") -> DataFrame:
    """The other columns of files, and position and value of each line of the file that ``path`` names, its unfinished last one too.

    Files are read by the tasks, a large one in ranges by several; a file that can't be read has no lines. Nothing of it passes through the driver.
    """
    keep = [x for x in files.columns if x != path]
    kinds = dict(files.dtypes)
    own = ", ".join(f"`{x}` {kinds[x]}" for x in keep)
    lead = f"{own}, " if own else ""
    found = files.select(*keep, path).filter(F.col(path).isNotNull() & (F.col(path) != ""))
    parts = found.mapInArrow(_sizes([*keep, path, "start", "end", "last"]), f"{lead}`{path}` string, start bigint, end bigint, last boolean")
    return parts.repartition(path, "start").mapInArrow(_read([*keep, "position", "value"]), f"{lead}position bigint, value string")

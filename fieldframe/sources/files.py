"""Listing and splitting of binary files for the data sources.

The driver only lists names and sizes. Headers are read inside the tasks, a large file
is cut into pieces, and small files share a partition.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

#: Bytes of input per partition.
TARGET_BYTES = 128 << 20
#: Rows per Arrow batch handed to Spark.
BATCH_ROWS = 1 << 16

_FRAME = re.compile(r"(\d+)\.[A-Za-z0-9]+$")


@dataclass(frozen=True)
class Piece:
    """Part ``part`` of ``parts`` equal shares of the records of a file."""

    path: str
    size: int
    part: int
    parts: int

    def share(self, count: int) -> tuple[int, int]:
        """Record range of this piece."""
        return count * self.part // self.parts, count * (self.part + 1) // self.parts


@dataclass
class Pieces(D.InputPartition):
    pieces: tuple[Piece, ...]

    def __init__(self, pieces: tuple[Piece, ...]) -> None:
        super().__init__(0)
        self.pieces = pieces


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, for URIs and plain paths."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def frame_of(path: str) -> int | None:
    """Frame number in front of the suffix of a file name."""
    found = _FRAME.search(posixpath.basename(path))
    return int(found.group(1)) if found else None


def list_files(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the matching files below a folder."""
    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found
                  if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


#: Bytes that reading only the beginning of a file counts for when files are packed.
HEADER_BYTES = 1 << 20


def plan_headers(files: list[tuple[str, int]], target: int) -> list[Pieces]:
    """Every file whole, many to a task: only their beginnings are read."""
    share = max(1, target // HEADER_BYTES)
    return [Pieces(tuple(Piece(path, size, 0, 1) for path, size in files[i:i + share])) for i in range(0, len(files), share)]


def target_for(files: list[tuple[str, int]], target: int, pieces: int) -> int:
    """A target that cuts the files into about ``pieces`` at most, as long as that leaves TARGET_BYTES a piece."""
    total = sum(size for _, size in files)
    return max(target, min(TARGET_BYTES, -(-total // pieces)))


def plan(files: list[tuple[str, int]], target: int) -> list[Pieces]:
    """Cut large files, pack small ones."""
    groups: list[Pieces] = []
    current: list[Piece] = []
    filled = 0
    for path, size in files:
        parts = max(1, -(-size // target))
        if parts > 1:
            groups += [Pieces((Piece(path, size, k, parts),)) for k in range(parts)]
            continue
        if current and filled + size > target:
            groups.append(Pieces(tuple(current)))
            current, filled = [], 0
        current.append(Piece(path, size, 0, 1))
        filled += size
    if current:
        groups.append(Pieces(tuple(current)))
    return groups


def _keeps(frame: int | None, test: D.Filter) -> bool:
    """Whether a file of this frame can satisfy a filter on the frame column."""
    if isinstance(test, D.EqualTo):
        return frame == test.value
    if isinstance(test, D.In):
        return frame in test.value
    if frame is None:
        return False
    if isinstance(test, D.GreaterThan):
        return frame > test.value
    if isinstance(test, D.GreaterThanOrEqual):
        return frame >= test.value
    if isinstance(test, D.LessThan):
        return frame < test.value
    return frame <= test.value


_FRAME_TESTS = (D.EqualTo, D.In, D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)


class PieceReader(D.DataSourceReader):
    """Reads pieces through ``decode(stream, piece, frame, wanted) -> batches of columns``.

    Filters on ``frame`` prune files by name before any is opened (Spark hands them over
    when ``spark.sql.python.filterPushdown.enabled`` is set); the options ``startFrame``
    and ``endFrame`` do the same explicitly. ``targetBytes`` is the size of a piece; with the
    option ``pieces`` a small target grows with the data, so that tasks do not outnumber their work.
    """

    def __init__(self, options: dict, schema: StructType, pattern: str, decode: Callable) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is required")
        self.target = int(options.get("targetBytes", TARGET_BYTES))
        self.pieces = int(options.get("pieces", 0))
        self.pattern = options.get("pattern", pattern)
        self.start, self.end = options.get("startframe"), options.get("endframe")
        self.start = options.get("startFrame", self.start)
        self.end = options.get("endFrame", self.end)
        self.headers = options.get("what") in ("header", "axes")
        self.wanted = schema
        self.decode = decode
        self.tests: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for test in filters:
            if isinstance(test, _FRAME_TESTS) and test.attribute == ("frame",):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Pieces]:
        files = []
        for path, size in list_files(self.path, self.pattern):
            frame = frame_of(path)
            if self.start is not None and (frame is None or frame < int(self.start)):
                continue
            if self.end is not None and (frame is None or frame > int(self.end)):
                continue
            if all(_keeps(frame, t) for t in self.tests):
                files.append((path, size))
        if self.headers:
            return plan_headers(files, self.target)
        return plan(files, target_for(files, self.target, self.pieces) if self.pieces else self.target)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.wanted)
        for piece in partition.pieces if partition else ():
            system, inner = filesystem(piece.path)
            with system.open_input_file(inner) as stream:
                for columns in self.decode(stream, piece, frame_of(piece.path), set(self.wanted.names)):
                    arrays = [pa.array(columns[f.name], type=f.type, from_pandas=False)
                              if not isinstance(columns[f.name], pa.Array) else columns[f.name]
                              for f in schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def constant(value, n: int, kind: pa.DataType) -> pa.Array:
    """Array repeating one value, NULL included."""
    return pa.repeat(pa.scalar(value, kind), n)

"""Compact 2-D fields: sizes, edges and six component planes (SRC3)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from fieldframe.sources.files import BATCH_ROWS, Piece, PieceReader, constant

COMPONENTS = ("bx", "by", "bz", "vx", "vy", "vz")
SCHEMA = ("frame int, ix int, iy int, x double, y double, bx double, by double, bz double, "
          "vx double, vy double, vz double, path string")
AXES_SCHEMA = "frame int, axis string, i int, lo double, hi double, center double, path string"


def _read_axes(stream, piece: Piece) -> tuple[int, int, np.ndarray, np.ndarray, int]:
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError(f"{piece.path} ends inside its header")
    nx, ny = struct.unpack("<ii", head)
    if nx <= 0 or ny <= 0:
        raise ValueError(f"{piece.path} has no cells")
    start = 8 + 8 * (nx + 1 + ny + 1)
    expected = start + len(COMPONENTS) * 8 * nx * ny
    if piece.size != expected:
        raise ValueError(f"{piece.path} has {piece.size} bytes, its header promises {expected}")
    edges = np.frombuffer(stream.read(start - 8), dtype="<f8")
    return nx, ny, edges[: nx + 1], edges[nx + 1:], start


def decode_cells(stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    nx, ny, xe, ye, start = _read_axes(stream, piece)
    first, last = piece.share(ny)
    lines = max(1, BATCH_ROWS // nx)
    x = 0.5 * (xe[:-1] + xe[1:])
    y = 0.5 * (ye[:-1] + ye[1:])
    while first < last:
        stop = min(first + lines, last)
        rows = stop - first
        n = rows * nx
        columns = {
            "frame": constant(frame, n, pa.int32()), "path": constant(piece.path, n, pa.string()),
            "ix": np.tile(np.arange(nx, dtype="i4"), rows),
            "iy": np.repeat(np.arange(first, stop, dtype="i4"), nx),
            "x": np.tile(x, rows), "y": np.repeat(y[first:stop], nx)}
        for k, name in enumerate(COMPONENTS):
            if name in wanted:  # planes of other components are never read
                stream.seek(start + 8 * (k * nx * ny + first * nx))
                columns[name] = np.frombuffer(stream.read(8 * n), dtype="<f8")
        yield columns
        first = stop


def decode_axes(stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    _, _, xe, ye, _ = _read_axes(stream, piece)
    for axis, e in (("x", xe), ("y", ye)):
        n = len(e) - 1
        yield {"frame": constant(frame, n, pa.int32()), "axis": constant(axis, n, pa.string()),
               "i": np.arange(n, dtype="i4"), "lo": e[:-1], "hi": e[1:], "center": 0.5 * (e[:-1] + e[1:]),
               "path": constant(piece.path, n, pa.string())}


class CompactFieldSource(DataSource):
    """``spark.read.format("compact_field")``; option ``what`` is cells or axes."""

    @classmethod
    def name(cls) -> str:
        return "compact_field"

    def schema(self) -> str:
        return AXES_SCHEMA if self.options.get("what", "cells") == "axes" else SCHEMA

    def reader(self, schema: StructType) -> PieceReader:
        decode = decode_axes if self.options.get("what", "cells") == "axes" else decode_cells
        return PieceReader(self.options, schema, "*.bin", decode)

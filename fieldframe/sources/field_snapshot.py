"""Self-describing field snapshots, versions 1 and 2 (SRC4)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from fieldframe.functions.constants import ENDIAN_MARKER, FIELD_MAGIC
from fieldframe.sources.files import BATCH_ROWS, Piece, PieceReader, constant

SCHEMA = ("frame int, ix int, iy int, iz int, x double, y double, z double, v1 double, v2 double, v3 double, "
          "field_name string, coordinate_unit string, value_unit string, coordinate_scale_cgs double, "
          "value_scale_cgs double, path string")
HEADER_SCHEMA = (
    "frame int, version int, space_dim int, component_dim int, output_component_dim int, coordinate_system int, "
    "domain int, nx int, ny int, nz int, point_count bigint, field_name string, coordinate_unit string, "
    "value_unit string, coordinate_scale_cgs double, value_scale_cgs double, path string")


def read_header(stream, piece: Piece) -> dict:
    head = stream.read(16)
    if len(head) < 16 or head[:8] != FIELD_MAGIC:
        raise ValueError(f"{piece.path}: unrecognized field snapshot magic")
    for order in "<>":
        version, marker = struct.unpack(f"{order}II", head[8:])
        if marker == ENDIAN_MARKER:
            break
    else:
        raise ValueError(f"{piece.path}: unsupported endian marker")
    if version not in (1, 2):
        raise ValueError(f"{piece.path}: unsupported field snapshot version {version}")

    def take(layout: str) -> tuple:
        size = struct.calcsize(order + layout)
        raw = stream.read(size)
        if len(raw) < size:
            raise ValueError(f"{piece.path} ends inside its header")
        return struct.unpack(order + layout, raw)

    ints = take("17i")
    points, name_size = take("QQ")
    unit_sizes, scales = (0, 0), (1.0, 1.0)
    if version == 2:
        unit_sizes, scales = take("QQ"), take("dd")
    name = stream.read(name_size).decode("utf-8")
    units = ["code_length", "code_value"]
    if version == 2:
        units = [stream.read(s).decode("utf-8") for s in unit_sizes]
    header = dict(zip(("space_dim", "component_dim", "output_component_dim", "coordinate_system", "domain",
                       "nx", "ny", "nz"), ints[:8]))
    header |= {"lower": ints[8:11], "upper": ints[11:14], "centering": ints[14:17], "point_count": points,
               "field_name": name, "coordinate_unit": units[0], "value_unit": units[1],
               "coordinate_scale_cgs": scales[0], "value_scale_cgs": scales[1], "version": version,
               "order": order, "start": stream.tell()}
    if not 1 <= header["space_dim"] <= 3 or header["output_component_dim"] not in (1, 3):
        raise ValueError(f"{piece.path}: dimensions out of range")
    if header["nx"] * header["ny"] * header["nz"] != points:
        raise ValueError(f"{piece.path}: the point count does not match the dimensions")
    if not (np.isfinite(scales).all() and min(scales) > 0.0):
        raise ValueError(f"{piece.path}: scales must be positive and finite")
    if piece.size < header["start"] + 8 * points * (3 + header["output_component_dim"]):
        raise ValueError(f"{piece.path} ends before its values")
    return header


def decode_points(stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    h = read_header(stream, piece)
    first, last = piece.share(h["point_count"])
    c = h["output_component_dim"]
    real = np.dtype(h["order"] + "f8")
    while first < last:
        n = min(BATCH_ROWS, last - first)
        index = np.arange(first, first + n)
        stream.seek(h["start"] + 24 * first)
        points = np.frombuffer(stream.read(24 * n), dtype=real).reshape(n, 3).astype("f8")
        stream.seek(h["start"] + 24 * h["point_count"] + 8 * c * first)
        values = np.frombuffer(stream.read(8 * c * n), dtype=real).reshape(n, c).astype("f8")
        columns = {
            "ix": (index % h["nx"] + h["lower"][0]).astype("i4"),
            "iy": (index // h["nx"] % h["ny"] + h["lower"][1]).astype("i4"),
            "iz": (index // (h["nx"] * h["ny"]) + h["lower"][2]).astype("i4"),
            "frame": constant(frame, n, pa.int32()), "path": constant(piece.path, n, pa.string())}
        columns |= {axis: points[:, k] for k, axis in enumerate("xyz")}
        columns |= {f"v{k + 1}": values[:, k] if k < c else np.zeros(n) for k in range(3)}
        columns |= {t: constant(h[t], n, pa.string()) for t in ("field_name", "coordinate_unit", "value_unit")}
        columns |= {s: constant(h[s], n, pa.float64()) for s in ("coordinate_scale_cgs", "value_scale_cgs")}
        yield columns
        first += n


def decode_header(stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    yield {k: [v] for k, v in (read_header(stream, piece) | {"frame": frame, "path": piece.path}).items()}


class FieldSnapshotSource(DataSource):
    """``spark.read.format("field_snapshot")``; option ``what`` is points or header."""

    @classmethod
    def name(cls) -> str:
        return "field_snapshot"

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("what", "points") == "header" else SCHEMA

    def reader(self, schema: StructType) -> PieceReader:
        decode = decode_header if self.options.get("what", "points") == "header" else decode_points
        return PieceReader(self.options, schema, "*.bin", decode)

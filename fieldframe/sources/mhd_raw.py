"""Raw single-precision MHD frames with two ghost layers (SRC5)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from fieldframe.sources.files import BATCH_ROWS, Piece, PieceReader, constant, filesystem

# Fields per cell, ghost layers per side, position of the kept components.
FIELDS = 8
GHOSTS = 2
POSITIONS = {"vx": 0, "vy": 1, "vz": 2, "bx": 4, "by": 5, "bz": 6}
CONFIG_REALS = ("dx", "dy", "dz", "xmin", "ymin", "zmin", "xmax", "ymax", "zmax", "lx", "ly", "lz", "dt_out")
CONFIG_INTS = ("nx", "ny", "nz", "nxs", "nys", "nzs", "topox", "topoy", "topoz", "nvar", "bcx", "bcy", "bcz")
SCHEMA = ("frame int, ix int, iy int, x double, y double, bx double, by double, bz double, "
          "vx double, vy double, vz double, path string")


def read_config(path: str) -> dict:
    """The configuration record that belongs to raw frames."""
    system, inner = filesystem(path)
    layout = f"<{len(CONFIG_REALS)}d{len(CONFIG_INTS)}i"
    with system.open_input_file(inner) as stream:
        raw = stream.read(struct.calcsize(layout))
    if len(raw) < struct.calcsize(layout):
        raise ValueError(f"{path} is too short for a configuration")
    config = dict(zip(CONFIG_REALS + CONFIG_INTS, struct.unpack(layout, raw)))
    if config["nx"] <= 0 or config["ny"] <= 0 or config["nz"] != 1:
        raise ValueError("only positive 2-D configurations are supported")
    return config


def decode_cells(config: dict, stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    nx, ny = config["nx"], config["ny"]
    line = (nx + 2 * GHOSTS) * FIELDS
    if piece.size < 4 * line * (ny + 2 * GHOSTS):
        raise ValueError(f"{piece.path} is too short for {nx} x {ny} cells")
    dx, dy = (config["xmax"] - config["xmin"]) / nx, (config["ymax"] - config["ymin"]) / ny
    xe, ye = config["xmin"] + np.arange(nx + 1) * dx, config["ymin"] + np.arange(ny + 1) * dy
    x, y = 0.5 * (xe[:-1] + xe[1:]), 0.5 * (ye[:-1] + ye[1:])
    first, last = piece.share(ny)
    lines = max(1, BATCH_ROWS // nx)
    while first < last:
        stop = min(first + lines, last)
        rows = stop - first
        stream.seek(4 * line * (first + GHOSTS))
        raw = np.frombuffer(stream.read(4 * line * rows), dtype="<f4").reshape(rows, nx + 2 * GHOSTS, FIELDS)
        inner = raw[:, GHOSTS: GHOSTS + nx, :]
        n = rows * nx
        columns = {
            "frame": constant(frame, n, pa.int32()), "path": constant(piece.path, n, pa.string()),
            "ix": np.tile(np.arange(nx, dtype="i4"), rows), "iy": np.repeat(np.arange(first, stop, dtype="i4"), nx),
            "x": np.tile(x, rows), "y": np.repeat(y[first:stop], nx)}
        columns |= {c: inner[:, :, k].astype("f8").ravel() for c, k in POSITIONS.items() if c in wanted}
        yield columns
        first = stop


class MhdRawSource(DataSource):
    """``spark.read.format("mhd_raw").option("config", path)``, or with nx, ny and the domain bounds."""

    @classmethod
    def name(cls) -> str:
        return "mhd_raw"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PieceReader:
        o = self.options
        if o.get("config"):
            config = read_config(o["config"])
        else:
            config = {"nx": int(o["nx"]), "ny": int(o["ny"])}
            config |= {k: float(o.get(k, default)) for k, default in
                       (("xmin", 0.0), ("xmax", 1.0), ("ymin", 0.0), ("ymax", 1.0))}
        return PieceReader(o, schema, "*", partial(decode_cells, config))

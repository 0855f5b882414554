"""Write small binary files from tables, as input for the source queries and tests."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldframe.functions.constants import ENDIAN_MARKER, FIELD_MAGIC, PARTICLE_MAGIC, PARTICLE_MAGIC_V2
from fieldframe.sources.files import filesystem
from fieldframe.sources.mhd_raw import FIELDS, GHOSTS, POSITIONS
from fieldframe.sources.particle_snapshot import record_type


def put(path: str, content: bytes) -> int:
    """Write one file, creating its folder."""
    system, inner = filesystem(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner) as stream:
        stream.write(content)
    return len(content)


def particle_bytes(rows: pd.DataFrame, version: int = 4, dim: int = 2, order: str = "<", species: int = 3,
                   capacity: int | None = None) -> bytes:
    """A snapshot of the columns particle_id, status, split_level, x, y, z, p, mu, weight."""
    n = len(rows)
    records = np.zeros(n, dtype=record_type(version, dim, order))
    for name in ("particle_id", "status", "split_level", "mu", "weight"):
        records[name] = rows[name]
    for k, axis in enumerate("xyz"[:dim]):
        records["pos"][:, k] = rows[axis]
        records["prev"][:, k] = rows[axis] - 1.0
    if version >= 4:
        records["p"] = rows["p"]
    else:
        records["momentum"][:, 0] = rows["p"]
    magic = PARTICLE_MAGIC if version >= 3 else PARTICLE_MAGIC_V2
    head = magic + struct.pack(f"{order}IIiiQ", version, ENDIAN_MARKER, dim, species, n)
    if version >= 3:
        head += struct.pack(f"{order}Q", n if capacity is None else capacity)
    head += struct.pack(f"{order}4d", 1.0, -1.0, 2.0, 3.0)
    if version >= 3:
        head += struct.pack(f"{order}2d", 2.0, 0.5)
    return head + records.tobytes()


def write_particles(particles: DataFrame, folder: str) -> int:
    """One snapshot per (batch, frame), names end in the frame number; returns the file count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            names = [(f"{folder}/{task:05d}-{k:05d}/particles_{int(frame):05d}.bin", rows)
                     for frame, rows in batch.groupby("frame")]
            yield pd.DataFrame({"path": [n for n, _ in names], "size": [put(n, particle_bytes(r)) for n, r in names]})

    ordered = particles.sortWithinPartitions("frame")
    return ordered.mapInPandas(run, "path string, size long").count()


def compact_field_bytes(rows: pd.DataFrame, x_edges: np.ndarray, y_edges: np.ndarray) -> bytes:
    """A compact field from one dense frame sorted by (iy, ix)."""
    nx, ny = len(x_edges) - 1, len(y_edges) - 1
    planes = b"".join(rows[c].to_numpy("<f8").tobytes() for c in ("bx", "by", "bz", "vx", "vy", "vz"))
    return struct.pack("<ii", nx, ny) + np.asarray(x_edges, "<f8").tobytes() + np.asarray(y_edges, "<f8").tobytes() + planes


def field_snapshot_bytes(rows: pd.DataFrame, nx: int, ny: int, version: int = 2, order: str = "<") -> bytes:
    """A 3-component field snapshot from one dense frame sorted by (iy, ix)."""
    name, units = b"magnetic_field", (b"code_length", b"code_value")
    head = FIELD_MAGIC + struct.pack(f"{order}II", version, ENDIAN_MARKER)
    head += struct.pack(f"{order}17i", 2, 3, 3, 0, 0, nx, ny, 1, 0, 0, 0, nx - 1, ny - 1, 0, 0, 0, 0)
    head += struct.pack(f"{order}QQ", nx * ny, len(name))
    if version == 2:
        head += struct.pack(f"{order}QQdd", len(units[0]), len(units[1]), 2.0, 0.5)
    head += name + (b"".join(units) if version == 2 else b"")
    real = np.dtype(f"{order}f8")
    points = rows[["ix", "iy"]].assign(z=0.0).to_numpy(real)
    values = rows[["bx", "by", "bz"]].to_numpy(real)
    return head + points.tobytes() + values.tobytes()


def mhd_raw_bytes(rows: pd.DataFrame, nx: int, ny: int) -> bytes:
    """A raw single-precision frame with ghost layers of -1."""
    raw = np.full((ny + 2 * GHOSTS, nx + 2 * GHOSTS, FIELDS), -1.0, dtype="<f4")
    for name, k in POSITIONS.items():
        raw[GHOSTS:-GHOSTS, GHOSTS:-GHOSTS, k] = rows[name].to_numpy().reshape(ny, nx)
    return raw.tobytes()


def write_frames(field: DataFrame, folder: str, prefix: str, encode) -> int:
    """One file per frame of a dense field; a frame is one grid, so its rows are bounded by the cells."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{prefix}{int(key[0]):05d}.bin"
        return pd.DataFrame({"path": [path], "size": [put(path, encode(rows.sort_values(["iy", "ix"])))]})

    return field.groupBy("frame").applyInPandas(run, "path string, size long").count()

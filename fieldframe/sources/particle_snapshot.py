"""Particle snapshots, versions 2 to 4, both byte orders (SRC1, SRC2, DQ9)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from fieldframe.functions.constants import ENDIAN_MARKER, PARTICLE_MAGIC, PARTICLE_MAGIC_V2
from fieldframe.sources.files import BATCH_ROWS, Piece, PieceReader, constant

_AXES = "xyz"
RECORD_SCHEMA = (
    "frame int, particle_id bigint, status int, split_level int, sort_key int, "
    "x double, y double, z double, prev_x double, prev_y double, prev_z double, "
    "step_x double, step_y double, step_z double, px double, py double, pz double, "
    "p double, mu double, weight double, initial_kinetic_energy double, version int, path string")
HEADER_SCHEMA = (
    "frame int, version int, space_dim int, species int, particle_count bigint, particle_capacity bigint, "
    "rest_mass double, charge double, speed_of_light double, energy_scale_erg double, "
    "energy_split_ratio double, minimum_child_weight double, header_bytes int, record_bytes int, "
    "length bigint, path string")


def record_type(version: int, dim: int, order: str) -> np.dtype:
    """Packed record layout of a version."""
    real = f"{order}f8"
    fields = [("particle_id", f"{order}u8"), ("status", f"{order}i4"), ("split_level", f"{order}i4"),
              ("sort_key", f"{order}i4"), ("pos", real, (dim,)), ("prev", real, (dim,))]
    if version >= 3:
        fields.append(("step", real, (dim,)))
    fields.append(("p", real) if version >= 4 else ("momentum", real, (dim,)))
    fields += [(n, real) for n in ("mu", "weight", "initial_kinetic_energy")]
    return np.dtype(fields)


def read_header(stream, size: int) -> dict:
    """Header values of an open snapshot, with the byte order and record layout."""
    head = stream.read(16)
    if len(head) < 16 or head[:8] not in (PARTICLE_MAGIC, PARTICLE_MAGIC_V2):
        raise ValueError("unrecognized particle snapshot magic")
    for order in "<>":
        version, marker = struct.unpack(f"{order}II", head[8:16])
        if marker == ENDIAN_MARKER:
            break
    else:
        raise ValueError("unsupported endian marker")
    if not 2 <= version <= 4:
        raise ValueError(f"unsupported particle snapshot version: {version}")
    if (head[:8] == PARTICLE_MAGIC_V2) != (version == 2):
        raise ValueError("the magic does not fit the version")
    layout = f"{order}iiQ" + ("Q" if version >= 3 else "") + "dddd" + ("dd" if version >= 3 else "")
    names = ["space_dim", "species", "particle_count"] + (["particle_capacity"] if version >= 3 else []) + [
        "rest_mass", "charge", "speed_of_light", "energy_scale_erg"] + (
        ["energy_split_ratio", "minimum_child_weight"] if version >= 3 else [])
    raw = stream.read(struct.calcsize(layout))
    if len(raw) < struct.calcsize(layout):
        raise ValueError("the particle snapshot ends inside its header")
    header = {"particle_capacity": None, "energy_split_ratio": 2.0, "minimum_child_weight": 0.0}
    header |= dict(zip(names, struct.unpack(layout, raw)))
    if header["particle_capacity"] is None:
        header["particle_capacity"] = header["particle_count"]
    if not 1 <= header["space_dim"] <= 3:
        raise ValueError(f"invalid space dimension: {header['space_dim']}")
    kind = record_type(version, header["space_dim"], order)
    header |= {"version": version, "order": order, "header_bytes": 16 + len(raw),
               "record_bytes": kind.itemsize, "length": size}
    return header


def check_size(header: dict, path: str) -> None:
    """Payload must be exactly as long as the header says (DQ9)."""
    expected = header["header_bytes"] + header["particle_count"] * header["record_bytes"]
    if header["length"] < expected:
        raise ValueError(f"{path} ends before all particle records")
    if header["length"] > expected:
        raise ValueError(f"{path} has trailing bytes after its particle records")


def columns_of(records: np.ndarray, header: dict, wanted: set[str]) -> dict:
    """Wanted columns of a block of records; fields that a version lacks are NULL."""
    n, dim, version = len(records), header["space_dim"], header["version"]
    out: dict = {}

    def vector(prefix: str, field: str, absent_zero: bool = True) -> None:
        for k, axis in enumerate(_AXES):
            name = prefix + axis
            if name not in wanted:
                continue
            if field not in records.dtype.names:
                out[name] = constant(None, n, pa.float64())
            elif k < dim:
                out[name] = records[field][:, k].astype("f8")
            else:
                out[name] = np.zeros(n)

    for prefix, field in (("", "pos"), ("prev_", "prev"), ("step_", "step"), ("p", "momentum")):
        vector(prefix, field)
    if "particle_id" in wanted:
        if n and records["particle_id"].max() >= 2 ** 63:
            raise ValueError("particle ids of 2^63 and more are not supported")
        out["particle_id"] = records["particle_id"].astype("i8")
    for name in ("status", "split_level", "sort_key"):
        if name in wanted:
            out[name] = records[name].astype("i4")
    for name in ("mu", "weight", "initial_kinetic_energy"):
        if name in wanted:
            out[name] = records[name].astype("f8")
    if "p" in wanted:
        out["p"] = (records["p"].astype("f8") if version >= 4
                    else np.sqrt((records["momentum"].astype("f8") ** 2).sum(axis=1)))
    return out


def decode_records(stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    header = read_header(stream, piece.size)
    check_size(header, piece.path)
    kind = record_type(header["version"], header["space_dim"], header["order"])
    first, last = piece.share(header["particle_count"])
    stream.seek(header["header_bytes"] + first * kind.itemsize)
    while first < last:
        n = min(BATCH_ROWS, last - first)
        records = np.frombuffer(stream.read(n * kind.itemsize), dtype=kind)
        columns = columns_of(records, header, wanted)
        columns |= {"frame": constant(frame, n, pa.int32()), "version": constant(header["version"], n, pa.int32()),
                    "path": constant(piece.path, n, pa.string())}
        yield columns
        first += n


def decode_header(stream, piece: Piece, frame: int | None, wanted: set[str]) -> Iterator[dict]:
    header = read_header(stream, piece.size)
    if header["particle_count"] >= 2 ** 63 or header["particle_capacity"] >= 2 ** 63:
        raise ValueError("particle counts of 2^63 and more are not supported")
    yield {k: [v] for k, v in (header | {"frame": frame, "path": piece.path}).items()}


class ParticleSnapshotSource(DataSource):
    """``spark.read.format("particle_snapshot").load(path)``.

    Options: ``what`` (records or header), ``pattern``, ``targetBytes``, ``pieces``,
    ``startFrame``, ``endFrame``. A schema with fewer columns leaves the other record fields undecoded.
    """

    @classmethod
    def name(cls) -> str:
        return "particle_snapshot"

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("what", "records") == "header" else RECORD_SCHEMA

    def reader(self, schema: StructType) -> PieceReader:
        decode = decode_header if self.options.get("what", "records") == "header" else decode_records
        return PieceReader(self.options, schema, "*.bin", decode)

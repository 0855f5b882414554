"""WARC archives: writing, and normalising monolithic gzip files.

A monolithic archive is one gzip stream around all records, so nothing in it can be read without inflating
everything before. The normaliser inflates such a file once, front to back, writes every record as a gzip member
of its own, and beside it a sidecar with the offset and length of each member. With the sidecar, any record is one
ranged read, and reading is spread over tasks record by record.

Files are opened through Arrow's file systems, so the folder may be on any store it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm.common import small, staged

CHUNK = 1 << 20
#: Records of one ranged read, and the archive bytes one reading task is meant for.
READ_SLICE = 64 << 20
_DATE = "2024-01-01T00:00:00Z"
_RECORD_ID = "<urn:fieldframe:page:{}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    """``file:/x`` in the form that Arrow reads."""
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def _publish(store: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name; a task that runs again replaces its own earlier file."""
    if store.get_file_info(final).type != pafs.FileType.NotFound:
        store.delete_file(final)  # not every store renames onto a file
    store.move(temporary, final)


# -- writing -------------------------------------------------------------------------------------------------------

def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload where ``refers_to`` names the response's page."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _RECORD_ID.format(page_id)),
               ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("X-Payload-Length", str(size)), ("Content-Type", "text/html; charset=utf-8")]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", _RECORD_ID.format(refers_to))]
    return _record(headers, payload)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(folder)
        name = f"part-{task.partitionId():06d}.warc.gz"
        temporary = f"{root}/.{name}.{task.taskAttemptId()}"
        count, squeeze, out = 0, zlib.compressobj(6, zlib.DEFLATED, 31), None
        for batch in batches:
            for row in batch.to_pylist():
                out = out or store.open_output_stream(temporary)
                out.write(squeeze.compress(page_record(
                    row["page_id"], row["url"], row["payload"], row["payload_bytes"],
                    base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode(), row["refers_to"])))
                count += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            _publish(store, temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})
    return write


def choose_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_revisit_bytes: int = 0) -> DataFrame:
    """Decide response or revisit: (page_id, url, payload, payload_bytes, payload_sha1, refers_to).

    Of pages with equal payloads of at least ``min_revisit_bytes`` the largest id is the response and the others
    refer to it; smaller payloads are all responses. A null payload is empty. Rows that repeat the winner's id and
    payload are responses too; rows with a null id are responses of their own. Payloads are compared by SHA-256 and
    length; the digests meet after map-side combining. Payloads stay where they are if the revisits were counted to be
    few enough for a broadcast, else they are shuffled once, by id and digest. The revisits are written now.
    """
    html = F.coalesce(F.col(body_col), F.lit(""))
    # the id is compared through a string key so that null ids are kept by the plain equi-join
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    keys = rows.select("page_id", F.sha2("html", 256).alias("same"), F.octet_length("html").cast("long").alias("bytes"))
    winners = keys.groupBy("same", "bytes").agg(F.max("page_id").alias("winner"))
    revisits = (keys.join(winners, ["same", "bytes"])
                .filter((F.col("bytes") >= min_revisit_bytes) & (F.col("page_id") < F.col("winner")))
                .select("page_id", "same", F.col("winner").alias("refers_to")).distinct())
    body = F.col("html").cast("binary")
    known = small(staged(revisits, "warc-revisits"))
    joined = rows.withColumn("same", F.sha2("html", 256)).join(known, ["page_id", "same"], "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), body).otherwise(F.lit(b"")).alias("payload"),
                         F.octet_length("html").cast("long").alias("payload_bytes"),
                         F.sha1(body).alias("payload_sha1"), "refers_to")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (see :func:`choose_records`) as monolithic archives, one per partition with rows; runs now.

    Returns (file, records). A task writes to a name of its own and renames at the end, so a repeated task leaves
    one complete file.
    """
    store, root = _open(_uri(folder))
    store.create_dir(root, recursive=True)
    written = records.mapInArrow(_writer(_uri(folder)), "file string, records long")
    return records.sparkSession.createDataFrame(written.collect(), "file string, records long")


# -- normalising ---------------------------------------------------------------------------------------------------

class _Inflated(io.RawIOBase):
    """The inflated bytes of a gzip file, whether it is one stream or many members, read in bounded pieces."""

    def __init__(self, source) -> None:
        self.source, self.engine, self.rest = source, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.engine.eof:
                self.rest, self.engine = self.engine.unused_data, zlib.decompressobj(31)
                self.rest = self.rest.lstrip(b"\0")
            data = self.rest or self.source.read(CHUNK)
            if not data:
                return 0
            piece = self.engine.decompress(data, len(buffer))
            self.rest = self.engine.unconsumed_tail if not self.engine.eof else b""
            if piece:
                buffer[: len(piece)] = piece
                return len(piece)


def _headers(stream: io.BufferedReader) -> tuple[bytes, dict[str, str]] | None:
    """The raw header and its fields of the next record; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("a WARC header is cut off")
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join(raw) + b"\r\n", fields


def normalise_file(source, target, note) -> int:
    """Copy one archive record by record; ``note`` gets an index entry for each. Memory is one piece of a record."""
    stream, at, count = io.BufferedReader(_Inflated(source), CHUNK), 0, 0
    while (head := _headers(stream)) is not None:
        raw, fields = head
        squeeze, left = zlib.compressobj(6, zlib.DEFLATED, 31), int(fields.get("content-length", "0"))
        size = target.write(squeeze.compress(raw))
        while left:
            piece = stream.read(min(left, CHUNK))
            if not piece:
                raise ValueError("a WARC record is cut off")
            left -= len(piece)
            size += target.write(squeeze.compress(piece))
        size += target.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
        note({"offset": at, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"),
              "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")})
        at, count = at + size, count + 1
    return count


def _normaliser(folder: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, root = _open(folder)
        out_store, out_root = _open(target)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                temporary = f"{out_root}/.{name}.{attempt}"
                sidecar = f"{out_root}/.{name}.{attempt}.index"
                with store.open_input_stream(f"{root}/{name}", compression=None) as source, \
                        out_store.open_output_stream(temporary, compression=None) as archive, \
                        out_store.open_output_stream(sidecar, compression=None) as index:
                    count = normalise_file(source, archive, lambda e: index.write(json.dumps({"file": name, **e}).encode() + b"\n"))
                _publish(out_store, temporary, f"{out_root}/{name}")
                _publish(out_store, sidecar, f"{out_root}/{name}.index.json")
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})
    return run


def normalise(files: DataFrame, folder: str, target: str) -> int:
    """Normalise the archives ``files(file)`` of ``folder`` into ``target``; runs now, returns the number of records.

    Each file is one task's work, since a gzip stream can only be inflated from its start. Archives that already
    have a member for each record come out with the same records. An archive without records gives an empty
    archive and an empty sidecar; one that is cut off raises.
    """
    store, root = _open(_uri(target))
    store.create_dir(root, recursive=True)
    count = files.count()
    spread = files.select("file").repartitionByRange(max(1, count), "file")
    done = spread.mapInArrow(_normaliser(_uri(folder), _uri(target)), "file string, records long")
    return done.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]


# -- reading -------------------------------------------------------------------------------------------------------

def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars: (file, offset, length, type, id, uri, digest), one row per record."""
    schema = "file string, offset long, length long, type string, id string, uri string, digest string"
    return spark.read.schema(schema).json(f"{folder}/*.index.json")


_READ = "uri string, record_id string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    name, source = file, store.open_input_file(f"{root}/{file}")
                data = zlib.decompress(source.read_at(length, offset), 31)
                head, fields = _headers(stream := io.BufferedReader(io.BytesIO(data)))
                block = stream.read(int(fields["content-length"]))
                stated = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and payload_digest(block) != stated:
                    raise ValueError(f"{file} at {offset}: the payload does not have the stated digest")
                rows.append((fields.get("warc-target-uri"), fields["warc-record-id"], fields["warc-type"],
                             fields.get("warc-refers-to"), stated, int(fields.get("x-payload-length", len(block))),
                             block if with_payload else None))
            types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _READ.split(", ")])
    return run


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Read normalised archives record by record through their sidecars, in slices of ``READ_SLICE`` bytes.

    Columns: uri, record_id, record_type, refers_to (a record id), payload_digest, payload_bytes (of the full
    payload, for revisits too) and payload. A response whose bytes do not have the stated digest raises. There are as
    many tasks as slices, which are counted first: by the bytes of the sidecars alone they would be merged.
    """
    sliced = read_index(spark, folder).select("file", "offset", "length", F.expr(f"offset div {READ_SLICE}").alias("slice"))
    slices = sliced.groupBy("file", "slice").agg(F.lit(1)).count()
    ordered = sliced.repartitionByRange(max(1, slices), "file", "slice").sortWithinPartitions("file", "offset")
    return ordered.select("file", "offset", "length").mapInArrow(_reader(_uri(folder), with_payload), _READ)

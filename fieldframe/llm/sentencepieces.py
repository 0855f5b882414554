"""SentencePiece encoding and decoding through a table of distinct chunks.

The library marks every space with U+2581 and puts one mark in front. Where no piece of the model has a mark after
another character, no merge can cross such a place, so a text falls into chunks (marks and the word behind them)
that are segmented independently. Each task keeps a table of the distinct chunks it has met, segments a new chunk
once, and joins ids and surfaces back to the texts by position. The table stays with the task: a corpus-wide one
would have to move every position of every text through a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A task starts a new table when it has met this many distinct chunks, and works on about this many characters at once.
TABLE_CHUNKS, SLICE_CHARS = 300_000, 2_000_000
_CHUNK = re.compile(" +[^ ]*")


@lru_cache(maxsize=2)
def _model(path: str):
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def chunks_are_independent(path: str) -> bool:
    """Whether no piece crosses a mark, the mark is a piece, and spaces are marked singly with one mark in front."""
    model = _model(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    crossing = re.compile(f"[^{MARK}]{MARK}")
    probe = [model.id_to_piece(i) for i in model.encode("  a  b ")]
    return not any(crossing.search(p) for p in pieces) and model.piece_to_id(MARK) != model.unk_id() and "".join(probe) == f"{MARK * 3}a{MARK * 2}b{MARK}"


class ChunkTable:
    """Distinct chunks with their ids and decoded surfaces, each segmented once."""

    def __init__(self, path: str) -> None:
        self.model, self.whole = _model(path), not chunks_are_independent(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.surface: list[str] = []
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return [" " + text] if self.whole else _CHUNK.findall(" " + text.replace(MARK, " "))

    def add(self, fresh: list[str]) -> None:
        if not fresh:
            return
        # the library puts the first mark in front by itself
        coded = self.model.encode([c[1:] for c in fresh], num_threads=1)
        if " " in fresh:  # a mark at the end of a text; the library takes it for an empty input
            coded[fresh.index(" ")] = [self.model.piece_to_id(MARK)]
        # and drops a first mark when decoding
        self.surface += [" " + s for s in self.model.decode(coded, num_threads=1)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        flat = np.fromiter((i for ids in coded for i in ids), np.int32, int(sizes.sum()))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.ids = np.concatenate([self.ids, flat])
        self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, sizes])

    def encode(self, texts: list[str], end: list[int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts in a row, the number for each text, and the decoded texts."""
        split = [self.chunks(t) for t in texts]
        known = self.place
        self.add(list(dict.fromkeys(c for chunks in split for c in chunks if c not in known)))
        surface, ids, sizes, decoded = self.surface, [], [], []
        for chunks in split:
            at = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
            length = self.length[at]
            total = int(length.sum())
            # position i of the text's ids lies (i - first position of its chunk) behind the chunk's first id
            source = np.repeat(self.start[at] - (np.cumsum(length) - length), length) + np.arange(total)
            ids += [self.ids[source], np.array(end, np.int32)]
            sizes.append(total + len(end))
            decoded.append("".join([surface[i] for i in at.tolist()])[1:])
        return np.concatenate(ids) if ids else np.empty(0, np.int32), np.array(sizes, np.int64), decoded


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _encoder(path: str, end: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                if len(table.place) > TABLE_CHUNKS:
                    table.clear()
                ids, sizes, decoded = table.encode(texts[a:b], end)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                     pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  end_ids: tuple[int, ...] | None = None) -> DataFrame:
    """Per row: id, ids (array<int>, closed by the model's end id or ``end_ids``), decoded (what those ids decode to).

    Ids equal those of the library without sampling. A null or empty text has the end id only and decodes to the
    empty text; U+2581 in a text acts as a space, as in the library. Null ids, repeated rows and further columns pass
    or are ignored, an empty table gives no rows. There is no shuffle; a task holds one slice of texts and its table.
    A model whose pieces cross marks is used on whole texts instead of chunks.
    """
    end = [_model(model_path).eos_id()] if end_ids is None else list(end_ids)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(_encoder(model_path, end), f"id {kind}, ids array<int>, decoded string")
            .withColumnRenamed("id", id_col))

"""Byte-level BPE by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens: it starts with one state that allows every byte
after every byte, and each merge ``u v -> w``, in order of rank, puts in a gadget. The arcs of ``u`` lead to a copy of
their state that has no ``v``, and wherever ``u`` was allowed ``w`` is, leading where ``v`` led. What remains
accepts, for any byte string, exactly one sequence of tokens, the one that the merges give. All arcs of a token lead to
one state and many tokens share their arcs, so two class numbers a token and one table of bits hold the automaton.

A word is encoded by transitions from its first byte on: from the state at a position, the arcs whose labels come next
in the word are followed; exactly one arc arrives at each further position. The arcs that end at the word's end,
followed back, are its ids. Time is linear in the length of a word. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.sentencepieces import _slices

#: A task starts a new table of words when it has met this many distinct ones, and splits about so many words at once.
TABLE_WORDS, WORDS_AT_ONCE = 300_000, 200_000
#: Words up to so many bytes are encoded side by side, longer ones each by itself.
SHORT_BYTES, SHORT_AT_ONCE = 40, 50_000
#: The pattern of byte-level pre-splitting.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Blocks whose characters have had their class for long (Latin to Cyrillic, Latin and Greek extensions, common
#: punctuation, kana, Han, Hangul). Texts with others are split by the tokenizers library, whose Unicode version decides.
_SETTLED = regex.compile(r"[\x00-\u052f\u1e00-\u1fff\u2000-\u2064\u2190-\u23ff\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fef\uac00-\ud7a3\uff01-\uff9f]*")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary: itself, or the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Arcs:
    """The automaton while merges are put in: a state and a column for each token, a bit for each (state, column)."""

    def __init__(self, size: int, letters: list[int]) -> None:
        self.state, self.column = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.state[letters] = self.column[letters] = 0
        self.bits = np.zeros((64, 8), np.uint8)
        self.bits[0, 0] = 1
        # state 0 is the start as well
        self.state_uses, self.column_uses = [len(letters) + 1], [len(letters)]

    def _room(self) -> None:
        rows, width = self.bits.shape
        grow = (rows if len(self.state_uses) == rows else 0, width if len(self.column_uses) == 8 * width else 0)
        if any(grow):
            self.bits = np.pad(self.bits, ((0, grow[0]), (0, grow[1])))

    def allows(self, state: int, token: int) -> bool:
        c = self.column[token]
        return bool(self.bits[state, c >> 3] >> (c & 7) & 1)

    def merge(self, left: int, right: int, whole: int) -> None:
        """Put in the gadget of one merge."""
        if min(self.state[left], self.state[right]) < 0 or self.state[whole] >= 0:
            raise ValueError(f"merge {left} {right} -> {whole}: parts must be older, the whole new")
        state, column = int(self.state[left]), int(self.column[right])
        if not self.allows(state, right):
            raise ValueError(f"merge {left} {right} can never take place")
        self.state[whole], self.column[whole] = self.state[right], self.column[left]
        self.state_uses[self.state[right]] += 1
        self.column_uses[self.column[left]] += 1
        if self.state_uses[state] > 1:
            self._room()
            self.state_uses[state] -= 1
            copy = len(self.state_uses)
            self.bits[copy] = self.bits[state]
            self.state_uses.append(1)
            self.state[left] = state = copy
        # of a run of one token pairs are merged from the left, so the last, single one is followed neither by itself nor by a pair
        leaving = [right, whole] if left == right else [right]
        if self.column_uses[column] > len(leaving):
            self._room()
            self.column_uses[column] -= len(leaving)
            copy, rows = len(self.column_uses), len(self.state_uses)
            bit = self.bits[:rows, column >> 3] >> (column & 7) & 1
            self.bits[:rows, copy >> 3] |= bit << np.uint8(copy & 7)
            self.column_uses.append(len(leaving))
            self.column[leaving] = column = copy
        self.bits[state, column >> 3] &= np.uint8(255 ^ 1 << (column & 7))


class Automaton:
    """A compiled tokenizer: labels and classes of the tokens, the table of arcs, and a tree of labels.

    It is built from the JSON file of a byte-level BPE tokenizer; what the file may hold beyond that (normalisers,
    other splits, added tokens that strip or want whole words, dropout) raises ValueError. Its size is bounded by the vocabulary.
    """

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        model, split = file["model"], file["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not file["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                 and not split["add_prefix_space"] and (file["post_processor"] or {"type": "ByteLevel"})["type"] == "ByteLevel"
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]):
            raise ValueError("not a plain byte-level BPE tokenizer")
        vocab, byte = model["vocab"], byte_characters()
        size = max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]) + 1
        self.labels = [b""] * size
        for word, i in vocab.items():
            if not any(t["id"] == i for t in file["added_tokens"]):
                self.labels[i] = bytes(byte[c] for c in word)
        letters = [vocab[c] for c in byte]
        arcs = Arcs(size, letters)
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            arcs.merge(vocab[left], vocab[right], vocab[left + right])
        self.state, self.column = arcs.state, arcs.column
        self.bits = np.ascontiguousarray(arcs.bits[:len(arcs.state_uses), :(len(arcs.column_uses) + 7) // 8])
        self.length = np.array([len(x) for x in self.labels], np.int32)
        self._tree([i for i in range(size) if arcs.state[i] >= 0])
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        for content, i in self.added.items():
            self.labels[i] = content.encode()

    def _tree(self, tokens: list[int]) -> None:
        """``next[node, byte]`` over the labels; nodes with further bytes come first, -1 is none; ``token`` of a node or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        inner = sorted({self.labels[t][:k] for t in tokens for k in range(1, len(self.labels[t]))}, key=len)
        for label in [*inner, *(self.labels[t] for t in tokens)]:
            nodes.setdefault(label, len(nodes))
        self.inner = len(inner) + 1
        self.next = np.full((self.inner, 256), -1, np.int32)
        for label, node in nodes.items():
            if label:
                self.next[nodes[label[:-1]], label[-1]] = node
        self.token = np.full(len(nodes), -1, np.int32)
        for t in tokens:
            self.token[nodes[self.labels[t]]] = t

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their numbers; the words advance side by side."""
        sizes = np.array([len(w) for w in words], np.int32)
        width = int(sizes.max())
        text = np.zeros((len(words), width), np.uint8)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        state = np.zeros((len(words), width + 1), np.int32)
        arrived = np.zeros((len(words), width + 1), np.int32)
        for start in range(width):
            row = np.flatnonzero(sizes > start)
            node, at = np.zeros(len(row), np.int32), start
            while len(row):
                node = self.next[node, text[row, at]]
                at += 1
                found = node >= 0
                row, node = row[found], node[found]
                token = self.token[node]
                whole = np.flatnonzero(token >= 0)
                where, token = row[whole], token[whole]
                column = self.column[token]
                ok = self.bits[state[where, start], column >> 3] >> (column & 7).astype(np.uint8) & 1 == 1
                where, token = where[ok], token[ok]
                arrived[where, at], state[where, at] = token, self.state[token]
                on = (node < self.inner) & (sizes[row] > at)
                row, node = row[on], node[on]
        numbers = np.zeros(len(words), np.int64)
        back, place = [], sizes.copy()
        row = np.flatnonzero(place > 0)
        while len(row):
            token = arrived[row, place[row]]
            back.append((row, token))
            numbers[row] += 1
            place[row] -= self.length[token]
            row = row[place[row] > 0]
        ids, last = np.empty(int(numbers.sum()), np.int32), np.cumsum(numbers) - 1
        for step, (row, token) in enumerate(back):
            ids[last[row] - step] = token
        return ids, numbers

    def _long(self, word: bytes) -> list[int]:
        state, arrived = [0] * (len(word) + 1), [0] * (len(word) + 1)
        follow, token_at, column, to, bits, inner = self.next.item, self.token.item, self.column.item, self.state.item, self.bits.item, self.inner
        for start in range(len(word)):
            node, here = 0, state[start]
            for at in range(start, len(word)):
                node = follow(node, word[at])
                if node < 0:
                    break
                token = token_at(node)
                if token >= 0:
                    c = column(token)
                    if bits(here, c >> 3) >> (c & 7) & 1:
                        arrived[at + 1], state[at + 1] = token, to(token)
                if node >= inner:
                    break
        ids, at = [], len(word)
        while at:
            ids.append(arrived[at])
            at -= len(self.labels[arrived[at]])
        return ids[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split, non-empty words in a row, and the number of ids of each word."""
        short = [w for w in words if len(w) <= SHORT_BYTES]
        parts = [self._short(short[i:i + SHORT_AT_ONCE]) for i in range(0, len(short), SHORT_AT_ONCE)]
        long = [np.array(self._long(w), np.int32) for w in words if len(w) > SHORT_BYTES]
        is_short = np.array([len(w) <= SHORT_BYTES for w in words], bool)
        numbers = np.zeros(len(words), np.int64)
        numbers[is_short] = np.concatenate([n for _, n in parts]) if parts else 0
        numbers[~is_short] = [len(x) for x in long]
        ids, of_short = np.empty(int(numbers.sum()), np.int32), np.repeat(is_short, numbers)
        ids[of_short] = np.concatenate([i for i, _ in parts]) if parts else 0
        ids[~of_short] = np.concatenate(long) if long else 0
        return ids, numbers

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after the other; bytes that are no UTF-8 become U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _library_split():
    from tokenizers.pre_tokenizers import ByteLevel
    return ByteLevel(add_prefix_space=False, use_regex=True)


class WordTable:
    """Distinct words that a task has met, each encoded once."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        longest_first = sorted(automaton.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, fresh: list[str]) -> None:
        if not fresh:
            return
        ids, numbers = self.automaton.encode_words([w.encode() for w in fresh])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(numbers) - numbers])
        self.ids, self.length = np.concatenate([self.ids, ids]), np.concatenate([self.length, numbers])
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))

    def _words(self, text: str) -> Iterator[list[str] | str]:
        """The pre-split words of a text in lists, and added tokens by themselves."""
        for i, piece in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                yield piece
            elif piece:
                if _SETTLED.fullmatch(piece):
                    found = (m[0] for m in _SPLIT.finditer(piece)) if len(piece) > WORDS_AT_ONCE else iter(_SPLIT.findall(piece))
                else:
                    found = (piece[a:b] for _, (a, b) in _library_split().pre_tokenize_str(piece))
                while words := list(islice(found, WORDS_AT_ONCE)):
                    yield words

    def _look_up(self, pending: list[tuple[int, list[str] | str]], parts: list[list[np.ndarray]]) -> None:
        if len(self.place) > TABLE_WORDS:
            self.clear()
        known = self.place
        self._add(list(dict.fromkeys(w for _, words in pending if not isinstance(words, str) for w in words if w not in known)))
        for text, words in pending:
            if isinstance(words, str):
                parts[text].append(np.array([self.automaton.added[words]], np.int32))
                continue
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            length = self.length[at]
            # id i of these words lies (i - first id of its word) behind the word's first id in the table
            parts[text].append(self.ids[np.repeat(self.start[at] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        pending, waiting = [], 0
        for i, text in enumerate(texts):
            for words in self._words(text):
                pending.append((i, words))
                waiting += len(words)
                if waiting >= WORDS_AT_ONCE:
                    self._look_up(pending, parts)
                    pending, waiting = [], 0
        self._look_up(pending, parts)
        return [np.concatenate(p) if p else np.empty(0, np.int32) for p in parts]


@lru_cache(maxsize=2)
def compiled(path: str) -> Automaton:
    """The automaton of a tokenizer file, compiled once in this process."""
    with open(path, encoding="utf-8") as file:
        return Automaton(file.read())


def _encoder(shared, packed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        table = WordTable(automaton)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                coded = table.encode(texts[a:b])
                if packed:
                    ids = pa.array([x.astype("<u4").tobytes() for x in coded], pa.binary())
                else:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(x) for x in coded], pa.int64()), ids,
                     pa.array([automaton.decode(x.tolist()) for x in coded], pa.string())],
                    names=["id", "n_tokens", "ids", "decoded"])
    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids, and decoded (what those ids decode to).

    ``ids`` is an array<int> or, ``packed``, binary: each id as a little-endian unsigned 32-bit integer. They equal those
    of the tokenizers library without added special tokens; the strings of added tokens in a text become their
    ids, as there. A null or empty text has no ids and decodes to the empty text. Null ids and repeated rows pass, further
    columns of any name are ignored, an empty table gives no rows. The driver compiles the file; the automaton, bounded by
    the vocabulary (88 MB at 50,000 tokens, most of it the tree), is broadcast. There is no shuffle; a task holds one slice of texts and its
    table of distinct words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer_path))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}, decoded string"
    return rows.mapInArrow(_encoder(shared, packed), schema).withColumnRenamed("id", id_col)

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldframe.llm import byte_bpe, text_queries  # noqa: F401
from fieldframe.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, " ", "  a", "a  \n\n b\t", "'s it's we'll", "aaaaaaaaaaaaa" * 9, "é 𝕏 中文 ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b  <|endoftext|>",
         "\x00\x00 \x00<|endoftext|>", "𞤀 ՘ ౜ x", "the same " * 30000, "x" * 100_000, "́​\xa0\x85\x1c a", "12 345 ²³ Ⅷ", "�\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(spark, make, library):
    docs = make(list(enumerate(TEXTS)) + [(None, "null id"), (3, "twice"), (3, "twice")]).selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS `a.b`")
    out = byte_bpe.encode_decode(docs, PATH)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    expected = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == expected
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) and r["n_tokens"] == len(r["ids"]) for r in got)
    assert byte_bpe.encode_decode(make([]), PATH).count() == 0


def test_random_words_side_by_side_and_alone(library):
    automaton, rng = byte_bpe.compiled(PATH), np.random.default_rng(0)
    letters = np.array([b for c, b in byte_bpe.byte_characters().items()])
    words = [bytes(rng.choice(letters[:n], rng.integers(1, 60)).astype(np.uint8)) for n in (3, 26, 94, 256) for _ in range(300)]
    words += [bytes(rng.choice(list(b"etaoin she"), rng.integers(1, 60)).astype(np.uint8)) for _ in range(500)]
    ids, numbers = automaton.encode_words(words)
    shown = {b: c for c, b in byte_bpe.byte_characters().items()}
    want = [[t.id for t in library.model.tokenize("".join(shown[b] for b in w))] for w in words]
    assert ids.tolist() == [i for w in want for i in w] and numbers.tolist() == [len(w) for w in want]
    assert automaton._long(words[0]) == want[0]


def test_settled_characters_split_as_in_the_library():
    split = byte_bpe._library_split()
    for first in range(0, 0x110000, 64):
        block = "".join(chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000 and byte_bpe._SETTLED.fullmatch(chr(c)))
        text = "".join(f"a{c}1{c}!{c}" for c in block)
        assert byte_bpe._SPLIT.findall(text) == [text[a:b] for _, (a, b) in split.pre_tokenize_str(text)]


def test_gadgets_of_a_small_alphabet():
    """Every string over two letters has one accepted sequence, the merges' own; a pair of one letter merges from the left."""
    import itertools
    merges = [(0, 0, 2), (0, 1, 3), (2, 2, 4), (3, 3, 5), (1, 4, 6)]
    arcs = byte_bpe.Arcs(7, [0, 1])
    for m in merges:
        arcs.merge(*m)
    labels = {0: "a", 1: "b", 2: "aa", 3: "ab", 4: "aaaa", 5: "abab", 6: "baaaa"}
    for n in range(1, 11):
        for text in map("".join, itertools.product("ab", repeat=n)):
            want = ["ab".index(c) for c in text]
            for left, right, whole in merges:
                i = 0
                while i + 1 < len(want):
                    if want[i:i + 2] == [left, right]:
                        want[i:i + 2] = [whole]
                    i += 1
            paths = [(0, 0, [])]
            accepted = []
            while paths:
                at, state, ids = paths.pop()
                if at == n:
                    accepted.append(ids)
                paths += [(at + len(x), int(arcs.state[t]), [*ids, t]) for t, x in labels.items() if text.startswith(x, at) and arcs.allows(state, t)]
            assert accepted == [want]
    with pytest.raises(ValueError):
        arcs.merge(0, 0, 2)


def test_table_survives_clearing_and_small_batches(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "TABLE_WORDS", 3)
    monkeypatch.setattr(byte_bpe, "WORDS_AT_ONCE", 2)
    texts = [(t or "")[:500] for t in TEXTS]
    coded = byte_bpe.WordTable(byte_bpe.compiled(PATH)).encode(texts)
    assert [x.tolist() for x in coded] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

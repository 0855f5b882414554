import public_tokenizers
from sentencepiece import SentencePieceProcessor

from fieldframe.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", " a", "a  b", " a b ", "▁x", "▁▁", "\n", "a \n b", " x y", "</s> a\x00", "é 𝕏 中文 ▁ z", "a" * 5000, "the same the same " * 4000, "a"]


def test_equals_the_library(make):
    model = SentencePieceProcessor(model_file=PATH)
    docs = make(list(enumerate(TEXTS)) + [(None, "null id"), (3, "twice"), (3, "twice")])
    out = sentencepieces.encode_decode(docs, PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    expected = sorted((str(r["doc_id"]), model.encode(r["text"] or "", add_eos=True)) for r in docs.collect())
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == expected
    assert all(r["decoded"] == model.decode(r["ids"]) for r in got)
    assert sentencepieces.encode_decode(make([]), PATH).count() == 0


def test_table_survives_clearing_and_whole_text_mode(monkeypatch):
    model = SentencePieceProcessor(model_file=PATH)
    table = sentencepieces.ChunkTable(PATH)
    texts = [t or "" for t in TEXTS]
    for whole in (False, True):
        table.clear()
        table.whole = whole
        ids, sizes, decoded = table.encode(texts, [2])
        if not whole:
            assert ids.tolist() == [i for t in texts for i in model.encode(t, add_eos=True)]
        assert decoded[:2] == ["", ""] and len(sizes) == len(texts)
    before = len(table.place)
    table.encode(["the same"], [2])
    table.encode(["the same"], [2])
    assert len(table.place) == before + 1


def test_real_documents(spark, sf):
    model = SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in sentencepieces.encode_decode(docs, PATH).collect():
        assert r["ids"] == model.encode(texts[r["doc_id"]], add_eos=True) and r["decoded"] == model.decode(r["ids"])


def test_extra_columns_with_names_of_results(make):
    docs = make([(1, "a b", "x", "y", 3), (None, None, "x", "y", 3)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded").withColumnRenamed("n_chars", "id")
    out = sentencepieces.encode_decode(docs, PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == {1: "a b", None: ""}

import random

import numpy as np

from fieldframe.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "über", "ung", "ten"], "cc": ["ción", "que", "ar", "ña"]}


def text(lang, words, rng):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(words))


def corpus(n=60):
    rng = random.Random(5)
    return [(i, text(lang, rng.randint(3, 40), rng), lang) for i, lang in enumerate(list(SYLLABLES) * n)]


def test_held_out_accuracy_and_edge_texts(make):
    docs = make(corpus())
    model = langid.train(docs.filter("doc_id % 4 <> 2"), sample_texts=100)
    assert model.languages == sorted(SYLLABLES)
    held = docs.filter("doc_id % 4 = 2")
    got = {r["doc_id"]: r for r in langid.predict(held, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in truth]) > 0.97
    odd = make([(1, None), (2, ""), (3, "123 !?"), (None, "kalomi"), (5, "tu " * 60_000), (5, "tu " * 60_000)])
    rows = langid.predict(odd, model).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and [r["score"] for r in rows[:3]] == [0.0] * 3
    assert all(r["lang_pred"] == "aa" and 0 < r["score"] <= 1 for r in rows[3:])


def test_slices_do_not_change_a_prediction(monkeypatch):
    long = "kalomi über " * 500
    whole = np.sort(np.concatenate(list(langid.subwords(long))))
    monkeypatch.setattr(langid, "SLICE", 97)
    assert np.array_equal(np.sort(np.concatenate(list(langid.subwords(long)))), whole)


def test_nothing_to_learn(make):
    model = langid.train(make([(1, "abc"), (2, None, "xx")]))
    assert [r["lang_pred"] for r in langid.predict(make([(1, "abc")]), model).collect()] == ["und"]
    assert langid.predict(make([]), model).count() == 0


def test_every_language_is_learned(make):
    """201 languages, each with a word ending of its own; a small sample still holds all of them."""
    ending = {f"l{k:03d}": chr(0x4E00 + k) * 2 for k in range(201)}
    rows = [(10 * k + i, " ".join(f"ab{e} cd{e}" for _ in range(3 + i)), lang) for k, (lang, e) in enumerate(ending.items()) for i in range(6)]
    model = langid.train(make(rows), sample_texts=6, sample_pairs=201 * 60)
    assert model.languages == sorted(ending) and model.table.shape[1] == langid.WIDTH
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(make(rows), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9


def test_sample_does_not_depend_on_partitions(make):
    rows = corpus(20) + [(7, "kalomi tu " * n, "aa") for n in range(1, 30)]
    models = [langid.train(make(rows).repartition(n), sample_texts=15, sample_pairs=4_000) for n in (1, 7)]
    assert np.array_equal(models[0].table, models[1].table) and np.array_equal(models[0].bias, models[1].bias)


def test_scores_are_the_plain_softmax_of_averages(make):
    model = langid.train(make(corpus()))
    for r in langid.predict(make(corpus(5)).withColumnRenamed("source", "score").withColumnRenamed("n_chars", "accepted"), model).collect():
        text = next(t for i, t, _ in corpus(5) if i == r["doc_id"])
        rows = np.concatenate(list(langid.subwords(text)))
        z = (sum(model.table[k].astype(float) for k in rows) / len(rows) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-6

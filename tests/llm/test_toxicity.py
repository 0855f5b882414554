import random

import numpy as np

from fieldframe.llm import toxicity

RUDE = ["dummkopf", "nitwit", "blockhead"]


def corpus(n=400):
    rng = random.Random(3)
    parts = ["er", "tion", "an", "the", "ing", "re", "on", "st", "ou", "ea"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(4, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_texts_and_edge_texts(spark, make):
    rows = corpus()
    docs = make([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 5] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.fitted
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [(t, got[i]) for i, _, t in rows if i % 5 == 0]
    right = [(s >= 0.5) == bool(t) for t, s in held]
    assert np.mean(right) > 0.9
    odd = make([(1, None), (2, ""), (3, "x" * 100_000), (None, "nitwit"), (4, "a"), (4, "a")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "_text").withColumnRenamed("n_chars", "row")
    scored = toxicity.scored(odd, model)
    assert scored.columns == ["doc_id", "text", "_text", "row", "score"]
    values = [r["score"] for r in scored.collect()]
    assert all(0 <= v <= 1 for v in values) and values[0] == values[1] and values[4] == values[5]
    assert toxicity.scored(make([]), model).count() == 0


def test_nothing_to_learn(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(make([(1, "a")]), labels)
    assert not model.fitted and [r["score"] for r in toxicity.scored(make([(1, "a")]), model).collect()] == [0.0]


def test_windows_cover_the_whole_text():
    model = toxicity.fit([r[1] for r in corpus() if r[2]], [r[1] for r in corpus() if not r[2]], 0.25)
    for at in (0, 61, 3000, 5990):
        text = ("ea on " * 1000)[:6000]
        spoiled = text[:at] + " blockhead " + text[at:]
        assert toxicity.savings(spoiled, model.toxic, model.ordinary).max() > toxicity.savings(text, model.toxic, model.ordinary).max()


def test_a_stretch_is_seen_at_every_offset():
    model = toxicity.fit([r[1] for r in corpus() if r[2]], [r[1] for r in corpus() if not r[2]], 0.25)
    clean = "the ering onst anre " * 30
    for word in RUDE:
        for at in range(toxicity.STEP):
            spoiled = clean[:200 + at] + f" {word} " + clean[200 + at:]
            assert toxicity.savings(spoiled, model.toxic, model.ordinary).max() >= 2


def test_scores_are_the_plain_model_and_the_sample_is_ordered(spark, make):
    """Repeated ids with different texts, and another partitioning, leave the model as it is; scores follow from windows alone."""
    rows = corpus() + [(4, f"nitwit {n} an the", 1) for n in range(40)]
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in corpus()] * 2, "doc_id long, quality int, toxic int")
    models = [toxicity.train(make([r[:2] for r in rows]).repartition(n), labels.repartition(n)) for n in (1, 6)]
    assert models[0] == models[1] and models[0].left_out >= 0
    model = models[0]
    for r in toxicity.scored(make([r[:2] for r in rows[:30]]), model).collect():
        data = r["text"].lower().encode()
        a, b = (toxicity._compressor(d) for d in (model.toxic, model.ordinary))
        saved = [len(b.compress(data[i:i + toxicity.WINDOW])) - len(a.compress(data[i:i + toxicity.WINDOW]))
                 for i in range(0, max(1, len(data) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)]
        value = sum(w * x for w, x in zip(model.weights, toxicity.features(np.array(saved, float))))
        assert abs(r["score"] - 1 / (1 + np.exp(-max(-30, min(30, value))))) < 1e-9

"""Language identification from averaged hashed subword embeddings.

The subwords of a text (letter n-grams with word borders) are hashed to rows of an embedding table; their mean goes
through a linear softmax. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
texts. A temperature calibrates the probabilities on texts kept out of the training, and a threshold on them
rejects texts whose language is doubtful.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.common import small, staged

UNKNOWN = "und"
NGRAMS, BITS, WIDTH = (1, 2, 3, 4), 16, 16
#: The training sample: about this many texts of each language, and at most so many (subword, share) pairs over all
#: languages (12 bytes each), dealt evenly. Every language is learned; a text gives at least ``LEAST_PAIRS`` of its pairs.
SAMPLE_TEXTS, SAMPLE_PAIRS, LEAST_PAIRS = 500, 16_000_000, 1_000
EPOCHS, RATE = 6, 2.0
#: Share of wrong answers that accepted texts may have, as measured on the texts kept out.
ACCEPTED_ERROR = 0.01
#: Code points that are hashed at once.
SLICE = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points with one space for whatever is not a letter, and around the text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters()[code], code, 32)
    code = np.concatenate([[32], code, [32]]).astype(np.uint64)
    blank = code == 32
    return code[~(blank & np.concatenate([[False], blank[:-1]]))]


def subwords(text: str) -> Iterator[np.ndarray]:
    """Rows of the embedding table for all n-grams of the whole text, in slices."""
    code = _codes(text)
    for first in range(0, len(code), SLICE):
        for n in NGRAMS:
            part = code[first:first + SLICE + n - 1]
            size = len(part) - n + 1
            if size <= 0:
                continue
            value = np.full(size, n, np.uint64)
            for j in range(n):
                value = (value ^ part[j:j + size]) * _SPREAD
                value ^= value >> np.uint64(29)
            # borders may stand at either end of an n-gram, but not inside
            fine = part[:size] != 32 if n == 1 else ~((part[:size] == 32) & (part[n - 1:] == 32))
            for j in range(1, n - 1):
                fine &= part[j:j + size] != 32
            yield (value[fine] >> np.uint64(64 - BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    #: One row for each bucket: its embedding, or, where there are fewer languages than ``WIDTH``, that times the weights.
    table: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    #: Softmax weights of the averaged embedding, None where the table holds them already.
    weight: np.ndarray | None = None
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    threshold: float = 0.0

    def probabilities(self, text: str) -> np.ndarray:
        total, count = np.zeros(self.table.shape[1]), 0
        for rows in subwords(text):
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            count += len(rows)
        return _softmax((self._scores(total / max(count, 1)) + self.bias) / self.temperature)

    def _scores(self, mean: np.ndarray) -> np.ndarray:
        return mean if self.weight is None else mean @ self.weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether the probability is high enough to be relied on."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], seed: int = 7) -> Model:
    """Train on (language, rows, shares) of each text; every fifth text is kept out for the calibration."""
    model = Model(languages, bias=np.zeros(len(languages), np.float32))
    if not texts:
        return Model([])
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    weight, bias = random.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    learn = [t for i, t in enumerate(texts) if i % 5] or texts
    keep = [t for i, t in enumerate(texts) if i % 5 == 0]
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(learn)):
            language, rows, share = learn[i]
            rate = np.float32(RATE * (1 - step / steps))
            mean = share @ embed[rows]
            error = _softmax(mean @ weight + bias)
            error[language] -= 1
            back = weight @ error
            weight -= rate * np.outer(mean, error)
            bias -= np.float32(0.1) * rate * error
            # the share of a subword in the text scales its step; the root evens out long and short texts
            embed[rows] -= rate * np.outer(np.sqrt(share), back)
            step += 1
    model.bias = bias
    if len(languages) <= WIDTH:
        model.table = embed @ weight
    else:
        model.table, model.weight = embed, weight
    logits = np.array([model._scores(share @ model.table[rows]) + bias for _, rows, share in keep])
    truth = np.array([t[0] for t in keep])
    at = np.arange(len(truth))
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(_softmax(logits / t)[at, truth] + 1e-12).mean()))
    p = _softmax(logits / model.temperature)
    best, wrong = p.max(axis=1), p.argmax(axis=1) != truth
    order = np.argsort(-best)
    fine = np.flatnonzero(np.cumsum(wrong[order]) <= ACCEPTED_ERROR * np.arange(1, len(order) + 1))
    model.threshold = float(best[order][fine[-1]]) if len(fine) else 1.0
    return model


def _hashed(most: int):
    """Subword counts of texts; of a text with more than ``most`` different ones the most frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shares = [], []
            for text in batch.column("text").to_pylist():
                count = np.zeros(1 << BITS, np.int64)
                for part in subwords(text):
                    count += np.bincount(part, minlength=1 << BITS)
                used = np.flatnonzero(count)
                if len(used) > most:
                    used = np.sort(used[np.argsort(-count[used], kind="stable")[:most]])
                rows.append(used.astype(np.int32))
                shares.append((count[used] / max(1, count[used].sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("h"), pa.array(rows, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                names=["lang", "h", "rows", "shares"])
    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_texts: int = SAMPLE_TEXTS, sample_pairs: int = SAMPLE_PAIRS) -> Model:
    """Fit on a bounded sample of the labelled texts in ``docs``: those with the smallest hashes of their ids.

    Every language is learned, from about ``sample_texts`` of its texts; of several texts of one id the one with the smallest hash is taken.
    Tasks count the subwords; the driver receives the counts: ``sample_pairs`` over all languages, an equal part for each, filled
    in the order of the hashes, and from a text that alone has more the most frequent ones. Rows with a null text, language or id are passed over.
    With so many languages that a part has fewer than ``LEAST_PAIRS`` pairs the counts grow with them. Runs now.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    counts = staged(known.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")), "languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return Model([])
    part = max(LEAST_PAIRS, sample_pairs // len(languages))
    here = F.col("h").cast("double") / float(1 << 64) + 0.5
    drawn = (known.join(small(counts), "lang").filter(here < F.lit(float(sample_texts)) / F.col("texts"))
             .groupBy("lang", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))
    hashed = staged(drawn.mapInArrow(_hashed(part), "lang string, h long, rows array<int>, shares array<float>").filter(F.size("rows") > 0), "language-sample")
    upto = Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = hashed.withColumn("pairs", F.sum(F.size("rows")).over(upto)).filter(F.col("pairs") <= part).drop("pairs").orderBy("h", "lang").toArrow()
    number = {lang: i for i, lang in enumerate(languages)}
    told = held.column("lang").to_pylist()
    lists = [[x.values.to_numpy() for x in held.column(c)] for c in ("rows", "shares")]
    return fit([(number[lang], rows.astype(np.int64), shares) for lang, rows, shares in zip(told, *lists)], languages)


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("id"), pa.array([f[0] for f in found], pa.string()),
                       pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "accepted"])
    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (calibrated probability), accepted (false where the answer is to be rejected).

    ``lang_pred`` is always a learned language, or ``und`` with score 0 if the text is null or has no letter, or
    nothing was learned. Whole texts are read, in slices. Repeated rows get equal results, null ids pass, further
    columns are ignored, an empty table gives no rows. There is no shuffle. What is broadcast is a table of 2^16
    rows with ``WIDTH`` numbers at most, and ``WIDTH`` weights for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(_predictor(shared), f"id {kind}, lang_pred string, score double, accepted boolean")
            .withColumnRenamed("id", id_col))

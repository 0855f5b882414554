"""Toxicity by compression distance.

Two zstandard dictionaries are learned, one from toxic and one from ordinary text. A text is cut into overlapping
windows, each is compressed with both, and the bytes that the toxic dictionary saves tell how toxic the window is. A
logistic model, fitted on labelled texts that the dictionaries have not seen, turns the savings of all windows into
a calibrated score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldframe.llm.common import row_of, staged

#: The training sample: texts of each class, and the longest text (in characters) that may be one of them.
SAMPLE_TEXTS, SAMPLE_CHARS = 1800, 60_000
#: Window and step in bytes, and the longest learned stretch: windows overlap by as much, so no stretch is cut in all of them.
WINDOW, STRETCH_BYTES = 48, 26
STEP = WINDOW - STRETCH_BYTES
#: Bytes of common ordinary text at the start of both dictionaries, and of text of one class at their ends. Of what is
#: specific to toxic texts the strongest stretches have room; ``Model.left_out`` says how many bytes had none.
SHARED_BYTES, OWN_BYTES = 8000, 4000
#: A stretch of a word is specific to toxic texts from this many standard errors and this ratio of document frequencies on.
MIN_ERRORS, MIN_RATIO, MIN_TEXTS = 6.0, 8.0, 10
#: A toxic text that is missed counts as this many ordinary texts that are marked.
MISS_COST = 2.0
_STRIP = ".,!?;:\"'()"


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    #: Bytes of stretches specific to toxic texts that the dictionary had no room for.
    left_out: int = 0

    @property
    def fitted(self) -> bool:
        return bool(self.weights)


def _stretches(text: str) -> Counter:
    """Words with their borders and beginnings of words, each counted once for the text."""
    found = set()
    for word in set(text.lower().split()):
        word = word.strip(_STRIP)
        if len(word) >= 3 and len(word.encode("utf-8", "surrogatepass")) <= STRETCH_BYTES - 2:
            found.add(f" {word} ")
            found.update(f" {word[:n]}" for n in range(4, min(len(word), 9)))
    return Counter(found)


def _specific(own: Counter, n_own: int, other: Counter, n_other: int) -> list[str]:
    """Stretches of one class that the other hardly has, weakest first; none that a longer one explains."""
    error = {}
    for stretch, count in own.items():
        if count < MIN_TEXTS:
            continue
        a, b = count / n_own, (other[stretch] + 0.5) / n_other
        both = (count + other[stretch]) / (n_own + n_other)
        errors = (a - b) / math.sqrt(both * (1 - both) * (1 / n_own + 1 / n_other) or 1.0)
        if errors >= MIN_ERRORS and a / b >= MIN_RATIO:
            error[stretch] = errors
    longer = {}
    for stretch in error:
        for n in range(1, len(stretch)):
            longer[stretch[:n]] = max(longer.get(stretch[:n], 0), own[stretch])
    return sorted((s for s in error if longer.get(s, 0) < 0.9 * own[s]), key=error.get)


def _dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, int]:
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for text in texts:
            counts.update(_stretches(text))
    common = "".join(s for s, _ in in_ordinary.most_common(4000) if s.endswith(" ")).encode()
    specific = "".join(_specific(in_toxic, len(toxic), in_ordinary, len(ordinary))).encode()
    own = specific[-OWN_BYTES:]
    # what is specific to toxic texts meets as much further common text of ordinary ones at the same distance
    shared, further = common[:SHARED_BYTES], common[SHARED_BYTES:][: len(own)]
    return shared + own + b" " * 8, shared + further + b" " * (8 + len(own) - len(further)), len(specific) - len(own)


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=15, chain_log=15, hash_log=15, search_log=9, min_match=4, target_length=256,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    learned.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=learned, compression_params=settings)


def savings(text: str, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For each window of the whole text: compressed length with the ordinary less that with the toxic dictionary."""
    data = text.lower().encode("utf-8", "surrogatepass")
    a, b = _compressor(toxic).compress, _compressor(ordinary).compress
    windows = (data[i:i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP))
    return np.array([len(b(w)) - len(a(w)) for w in windows], float)


def features(saved: np.ndarray) -> list[float]:
    """What the savings of all windows say: how many reach each level, which share does, the largest, their number."""
    n = len(saved)
    return [1.0, math.log(n), *(math.log1p(float((saved >= level).sum())) for level in (2, 3, 4, 5, 6)),
            *(float((saved >= level).mean()) for level in (3, 4)), float(saved.max())]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x.T * s) @ x + ridge, x.T @ (weight * (y - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """Learn the dictionaries from two thirds of the texts and the logistic model from the rest.

    ``toxic_share`` is the share of toxic texts among all labelled ones; the texts of both classes are weighted to
    it, and toxic ones by ``MISS_COST`` besides. With fewer than six texts of a class nothing is learned: every score is 0.
    """
    if min(len(toxic), len(ordinary)) < 6:
        return Model(b"", b"", ())
    cut_t, cut_o = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    *dictionaries, left_out = _dictionaries(toxic[:cut_t], ordinary[:cut_o])
    rest = toxic[cut_t:] + ordinary[cut_o:]
    x = np.array([features(savings(t, *dictionaries)) for t in rest])
    y = np.array([1.0] * (len(toxic) - cut_t) + [0.0] * (len(ordinary) - cut_o))
    weight = np.where(y == 1, MISS_COST * toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    return Model(*dictionaries, tuple(_logistic(x, y, weight)), left_out)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", sample_texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on a bounded sample of labelled texts: ``sample_texts`` of each class, by the smallest hashes of their ids.

    Texts over ``SAMPLE_CHARS`` characters are not used for learning, and of several texts of one id the one with the
    smallest hash is. Rows without label or id, and texts that are null, are passed over. Runs now; the driver receives the sample.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    chosen = None
    for label in (0, 1):
        # a share that surely holds the sample, so that no task ranks more than a few times its rows
        share = min(1.0, 2.0 * sample_texts / max(1, counts.get(label, 0)))
        near = F.xxhash64(id_col).cast("double") / float(1 << 64) + 0.5 <= share
        part = known.filter((F.col("_toxic") == label) & near).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_texts)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = staged(chosen, "toxicity-sample")  # at most twice sample_texts rows
    rows = (docs.select(id_col, text_col).filter(F.length(text_col) <= SAMPLE_CHARS)
            .join(F.broadcast(chosen), id_col).groupBy(id_col, "_toxic").agg(F.min_by(text_col, F.struct(F.xxhash64(text_col), text_col)).alias("t"))
            .select(F.xxhash64(id_col).alias("h"), "t", "_toxic").collect())
    ordered = sorted(rows, key=lambda r: (r["h"], r["t"]))
    # copies count once
    texts = {label: list({r["t"].lower(): r["t"] for r in ordered if r["_toxic"] == label}.values()) for label in (0, 1)}
    total = sum(counts.values())
    return fit(texts[1], texts[0], counts.get(1, 0) / total if total else 0.0)


def score_text(text: str, model: Model) -> float:
    if not model.fitted:
        return 0.0
    value = float(np.dot(features(savings(text, model.toxic, model.ordinary)), model.weights))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, value))))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_text(t or "", model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"])
    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1; null and empty texts are scored as the empty text.

    Labels, ids and further columns play no part. Repeated rows get equal scores, an empty table gives no rows.
    There is no shuffle. A column of the name ``out`` is replaced.
    """
    rows = docs.select(row_of(docs, without=out), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])
    return rows.mapInArrow(_scorer(model), schema).select("row.*", F.col("score").alias(out))

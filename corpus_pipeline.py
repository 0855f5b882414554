"""From raw documents to token ids: five stages over the documents table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of the
documents. A stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe import configure
from fieldframe.llm import exact_dedup, mixing, partenum, sentencepieces, toxicity
from fieldframe.llm.common import read, row_of, small, staged
from fieldframe.llm.model_queries import learnable_labels

#: Documents scored at least so high are rejected.
TOXIC_SCORE = 0.5
#: Near duplicates share 80 of 100 shingles of five words.
NEAR = partenum.Join(width=5, under=80, over=100, second=2)
#: The budget is the least that keeps every document.
MIX = mixing.Mix(entropy=0.95, repeats=2.0, budget=None)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the model calls toxic."""
    model = toxicity.train(docs, learnable_labels(read(spark, sf_dir, "labels")))
    rows = docs.select(row_of(docs), F.col("text"))
    return toxicity.scored(rows, model).filter(F.col("score") < TOXIC_SCORE).select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the one with the smallest doc_id stays; rows without an id stay.

    Where an id has several texts, each goes by its own links.
    """
    gone = staged(partenum.near_duplicates(docs, join=NEAR), "near-duplicates")
    ids = gone.filter("digest IS NULL").select(F.col("id").alias("_id"))
    texts = gone.filter("digest IS NOT NULL").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("_id"))
    kept = rows.join(small(staged(ids, "near-ids")), "_id", "left_anti")
    if not texts.isEmpty():
        digest = F.sha2(F.coalesce(F.col("row.text"), F.lit("")), 256)
        kept = kept.withColumn("_digest", digest).join(small(staged(texts, "near-texts")), ["_id", "_digest"], "left_anti")
    return kept.select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of sources below their weight more often."""
    return mixing.repeat(docs, MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of what the ids decode to."""
    coded = sentencepieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_duplicates), ("near_duplicates", near_duplicates),
          ("source_mix", source_mix), ("token_ids", token_ids)]

#: Learned scores, links and segmentation cannot be stated in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again as the next stage's input."""
    configure(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

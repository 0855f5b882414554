"""Queries of the operators that learn from labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm import langid, toxicity
from fieldframe.llm.common import read
from fieldframe.llm.queries import register


def id_remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def learnable_labels(labels: DataFrame) -> DataFrame:
    """The labels that toxicity may be learned from."""
    return labels.filter(id_remainder(5) != 0)


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.filter(id_remainder(4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, learnable_labels(read(spark, sf_dir, "labels")))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))

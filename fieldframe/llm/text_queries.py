"""Queries of the operators on documents and conversations that join and group texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldframe.llm import byte_bpe, exact_dedup, fingerprints, mixing, partenum, reply_trees, sentencepieces
from fieldframe.llm.common import LOWER, UPPER, read
from fieldframe.llm.queries import register


@register("op6_exact_dedup", f"""
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
    FROM d""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read(spark, sf_dir, "documents"))


@register("op2_reply_trees", r"""
    WITH m AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    e AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\#<]')) AS t_len,
                 length(role) + len(regexp_extract_all(role, '[\\#<:]')) AS r_len FROM m)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(t_len + r_len + 14) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id""")
def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree whose turns reply to the turn before; all its paths (one) are formatted."""
    told = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], told.schema)
    in_turn = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    messages = told.unionByName(probe).select(
        F.col("conv_id").alias("tree"), F.row_number().over(in_turn).cast("long").alias("node"),
        (F.row_number().over(in_turn) - 1).cast("long").alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    read_back = (reply_trees.format_trees(messages)
                 .select("tree", F.length("formatted").cast("long").alias("formatted_chars"),
                         reply_trees.read_turns(F.col("formatted")).alias("turns"),
                         reply_trees.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@register("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(read(spark, sf_dir, "documents"))


@register("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), packed=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(read(spark, sf_dir, "documents"), join=partenum.Join(width=3, under=90, over=100))


MIX = mixing.Mix(entropy=0.95, repeats=2.0, budget=None, block_tokens=1_000_000)


@register("op4_source_mixing", f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
    s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total, count(*) AS docs FROM d GROUP BY source),
    l AS (SELECT list(CAST(total AS DOUBLE) / (SELECT max(total) FROM s)) AS ts, max(total) / min(total) AS ratio, count(*) AS n FROM s WHERE total > 0),
    b(i, elo, ehi, rlo, rhi) AS (
        SELECT 0, CASE WHEN h1 >= {MIX.entropy} * ln(n) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
        FROM (SELECT n, ln(list_sum(ts)) - list_sum(list_transform(ts, lambda x: x * ln(x))) / list_sum(ts) AS h1 FROM l)
        UNION ALL
        SELECT i + 1, CASE WHEN e_ok THEN em ELSE elo END, CASE WHEN e_ok THEN ehi ELSE em END,
               CASE WHEN r_ok THEN rlo ELSE rm END, CASE WHEN r_ok THEN rm ELSE rhi END
        FROM (SELECT i, elo, ehi, rlo, rhi, (elo + ehi) / 2 AS em, (rlo + rhi) / 2 AS rm,
                     ln(list_sum(list_transform(ts, lambda x: pow(x, (elo + ehi) / 2))))
                     - (elo + ehi) / 2 * list_sum(list_transform(ts, lambda x: pow(x, (elo + ehi) / 2) * ln(x)))
                       / list_sum(list_transform(ts, lambda x: pow(x, (elo + ehi) / 2))) >= {MIX.entropy} * ln(n) - 1e-12 AS e_ok,
                     pow(ratio, 1 - (rlo + rhi) / 2) <= {MIX.repeats} + 1e-12 AS r_ok
              FROM b, l WHERE i < 32)),
    a AS (SELECT ceil(greatest(elo, CASE WHEN rhi > 1e-9 THEN rhi ELSE 0 END) * 1e6 - 1e-3) / 1e6 AS a FROM b WHERE i = 32),
    w AS (SELECT s.*, CASE WHEN total > 0 THEN pow(total::DOUBLE, a) / (SELECT sum(pow(total::DOUBLE, (SELECT a FROM a))) FROM s WHERE total > 0) ELSE 0 END AS weight FROM s, a),
    q AS (SELECT *, CAST(round((SELECT max(round(total / weight)) FROM w WHERE total > 0) * weight) AS BIGINT) AS quota FROM w),
    e AS (SELECT *, CASE WHEN total > 0 THEN quota // total ELSE 1 END AS epochs FROM q),
    g AS (SELECT ceil(sum(quota) / {MIX.block_tokens}.0) AS blocks FROM e),
    c AS (SELECT doc_id, d.source, n_tokens, unnest(range(0, epochs + 1)) AS epoch, total, quota, epochs FROM d JOIN e USING (source)),
    p AS (SELECT *, ('0x' || substr(md5('{MIX.seed}:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place FROM c),
    m AS (SELECT *, quota - epochs * total AS rest FROM p WHERE epoch < epochs OR (quota > epochs * total AND n_tokens <= 2 * (quota - epochs * total))),
    r AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY place, doc_id) AS BIGINT) AS after,
                 CAST(sum(n_tokens) OVER (PARTITION BY source, epoch, place, doc_id) AS BIGINT) AS same FROM m),
    f AS (SELECT *, CASE WHEN quota > 0 THEN CAST(least(floor((epoch * total + after - n_tokens)::DOUBLE * blocks / quota), blocks - 1) AS BIGINT) ELSE 0 END AS block
          FROM r, g WHERE epoch < epochs OR after <= rest OR (after - same < rest AND after - rest <= rest - (after - same)))
    SELECT doc_id, source, n_tokens, epoch, block,
           row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5('{MIX.seed}-block:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT, epoch, doc_id) AS position
    FROM f""")
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read(spark, sf_dir, "documents"), MIX)

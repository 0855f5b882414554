"""Queries of the operators on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldframe.llm import url_filter, warc
from fieldframe.llm.common import LOWER, UPPER, read, shared_folder
from fieldframe.llm.queries import register


@register("op1_warc_normaliser", r"""
    WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
                      max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> top THEN top END AS refers_to
    FROM d""")
def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written as one stream each, normalised, and read back through the sidecars."""
    raw, tidy = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc")
    files = warc.write_archives(warc.choose_records(read(spark, sf_dir, "pages")), raw)
    warc.normalise(files, raw, tidy)
    number = r"(-?\d+)>$"
    found = warc.read_records(spark, tidy, with_payload=False)
    return found.select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.regexp_extract("refers_to", number, 1).try_cast("long").alias("refers_to"))


#: host, path, verdict
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@register("op3_url_filter", rf"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                      regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(rhost, rpath, verdict) AS (VALUES {', '.join(str(r) for r in RULES)}),
    hit AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
                   arg_max(r.verdict, length(rhost || rpath)) AS verdict
            FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY ALL)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, sf_dir, "pages"), rules)

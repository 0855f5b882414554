"""URL filters as a sort-merge range join.

A host is canonical when its labels are reversed, each followed by a separator. The subdomains of a rule's host are
then exactly the keys that start with the rule's key: an interval. URLs and rules are cut at the same boundaries into
ranges of the key order, a rule going to every range that its interval touches, and each range is swept in order
with a stack of the rule hosts that contain the current key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldframe.llm.common import LOWER, UPPER

SEPARATOR = "\u0001"
_LAST = "\U0010ffff"
#: Ranges for each shuffle partition, and sampled keys for each range; the driver sees only the sampled keys.
RANGES_PER_PARTITION, SAMPLES_PER_RANGE, SAMPLED_KEY_CHARS = 4, 16, 200


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_key(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.", -1)), SEPARATOR), F.lit(SEPARATOR))


def _boundaries(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Splits of the (key, tie) order into about even ranges, from a sample drawn by the hash ``tie``.

    The share of rows that is drawn follows from their number, so about ``ranges * SAMPLES_PER_RANGE`` reach the
    driver, whatever their number is.
    """
    wanted = ranges * SAMPLES_PER_RANGE
    share = min(1.0, wanted / max(1, keys.count()))
    drawn = F.xxhash64("tie", F.lit("range sample")).cast("double") / float(1 << 64) + 0.5 <= share
    picked = keys.filter(drawn).select(F.substring("key", 1, SAMPLED_KEY_CHARS).alias("key"), "tie").limit(2 * wanted).collect()
    points = sorted({(r["key"], r["tie"]) for r in picked})
    step = max(1, len(points) // ranges)
    return points[step::step][: ranges - 1]


def _ranged(boundaries: list[tuple[str, int]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rules (kind 0) reach every range between both ends of their interval, URLs (kind 1) one range
            keys, ties, kinds = (batch.column(c).to_pylist() for c in ("key", "tie", "kind"))
            rows, ranges = [], []
            for i, (key, tie, kind) in enumerate(zip(keys, ties, kinds)):
                first = bisect_right(boundaries, (key, tie)) if kind else bisect_right(boundaries, (key, -(1 << 63)))
                last = first if kind else bisect_right(boundaries, (key + _LAST, (1 << 63) - 1))
                for r in range(first, last + 1):
                    rows.append(i)
                    ranges.append(r)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), *taken.columns],
                                             names=["range", *batch.schema.names])
    return assign


class _Sweep:
    """The stack of rule hosts around the current key; each holds its rules by path."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, rule_path: str, rule: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, by_path, lengths = self.stack[-1]
        if rule_path not in by_path or verdict == "block":
            by_path[rule_path] = (rule, verdict)
        if len(rule_path) not in lengths:
            lengths.append(len(rule_path))
            lengths.sort(reverse=True)

    def judge(self, url_path: str) -> tuple[str | None, str | None]:
        best, most = (None, None), (-1, -1)
        for key, by_path, lengths in self.stack:
            for n in lengths:
                if n <= len(url_path) and (found := by_path.get(url_path[:n])):
                    if (len(key) + n, len(key)) > most:
                        best, most = found, (len(key) + n, len(key))
                    break
        return best


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep, current = _Sweep(), None
    for batch in batches:
        out: list[int] = []
        rules, verdicts = [], []
        columns = (batch.column(c).to_pylist() for c in ("range", "key", "kind", "path", "rule", "verdict"))
        for i, (r, key, kind, url_path, rule, verdict) in enumerate(zip(*columns)):
            if r != current:
                sweep, current = _Sweep(), r
            sweep.move(key)
            if kind == 0:
                sweep.open(key, url_path, rule, verdict)
            else:
                found, decided = sweep.judge(url_path)
                out.append(i)
                rules.append(found)
                verdicts.append(decided)
        kept = batch.select(["id", "host", "path"]).take(pa.array(out, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                                         names=["id", "host", "path", "rule", "verdict"])


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule (``host`` + ``path``, null if none fits), verdict.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains where the URL's path starts with the
    rule's path. The longest rule wins (host and path together, then the host); of repeated rules that disagree,
    ``block`` wins. Rules with a null or empty host fit nothing, a null path is empty. URLs no rule fits get
    ``default``; a null URL or one without ``://`` has an empty host and path. Repeated rows are judged row by row,
    a null id is allowed, further columns are ignored and empty tables give no rows.

    URLs are ordered by (key, id), so a host with many rows is spread over many ranges. The driver fetches a
    bounded sample of keys, ``RANGES_PER_PARTITION * SAMPLES_PER_RANGE`` for each shuffle partition.
    """
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = (urls.select(F.col(id_col).cast("long").alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
              .withColumn("key", reversed_key(F.col("host"))).withColumn("tie", F.xxhash64("id", "path"))
              .withColumns({"kind": F.lit(1), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")}))
    rule_path = F.coalesce("path", F.lit(""))
    lines = (rules.filter(F.coalesce("host", F.lit("")) != "")
             .select(F.lit(None).cast("long").alias("id"), F.translate("host", UPPER, LOWER).alias("host"),
                     rule_path.alias("path"), "verdict")
             .withColumn("rule", F.concat("host", "path"))
             .withColumn("key", reversed_key(F.col("host"))).withColumns({"tie": F.lit(0).cast("long"), "kind": F.lit(0)}))
    names = ["id", "host", "path", "key", "tie", "kind", "rule", "verdict"]
    cut = _ranged(_boundaries(points, parts * RANGES_PER_PARTITION))
    schema = "range int, id long, host string, path string, key string, tie long, kind int, rule string, verdict string"
    together = points.select(*names).unionByName(lines.select(*names)).mapInArrow(cut, schema)
    swept = (together.repartition(parts, "range").sortWithinPartitions("range", "key", "kind", "path")
             .mapInArrow(_swept, "id long, host string, path string, rule string, verdict string"))
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule",
                        F.coalesce("verdict", F.lit(default)).alias("verdict"))

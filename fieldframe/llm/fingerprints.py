"""Document fingerprints from prefix polynomial hashes.

A text of code points c_0 .. c_{n-1} gets modular prefix arrays P_i = sum of c_j * B^j (j < i) for two primes. The
hash of any span follows from two entries of the array, so any two spans compare in constant time, and the longest
common extension of two positions is found by binary search. A fingerprint takes the hashes of all spans of
``SPAN`` code points from the arrays and keeps, for each of ``SLOTS`` classes of hashes, the smallest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, SLOTS = 16, 64
PRIMES = (2147483647, 2147483629)
BASES = (1_000_003, 998_244_353)
_EMPTY = 0xFFFFFFFF


class _Powers:
    """B^i and B^-i modulo each prime, grown as longer texts come."""

    def __init__(self) -> None:
        self.size, self.up, self.down = 0, [], []

    def upto(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = max(n, 2 * self.size, 1 << 14)
        self.up = [_power_table(b, p, self.size) for b, p in zip(BASES, PRIMES)]
        self.down = [_power_table(pow(b, -1, p), p, self.size) for b, p in zip(BASES, PRIMES)]


def _power_table(base: int, prime: int, n: int) -> np.ndarray:
    table = np.ones(n, np.uint64)
    done = 1
    while done < n:  # each round doubles the known powers
        more = min(done, n - done)
        table[done:done + more] = table[:more] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += more
    return table


_POWERS = _Powers()


class Prefixes:
    """The prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        # one is added so that code point zero counts
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(code)
        _POWERS.upto(self.n + 1)
        self.sums = []
        for up, prime in zip(_POWERS.up, PRIMES):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(code * up[: self.n] % np.uint64(prime), out=total[1:])
            self.sums.append(total % np.uint64(prime))

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, stop)."""
        parts = []
        for sums, down, prime in zip(self.sums, _POWERS.down, PRIMES):
            p = np.uint64(prime)
            parts.append((sums[stop] + p - sums[start]) % p * down[start] % p)
        return parts[0] << np.uint64(31) | parts[1]

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size``; of the whole text if it is shorter."""
        if self.n < size:
            return self.spans(np.array([0]), np.array([self.n])) if self.n else np.empty(0, np.uint64)
        parts = []
        for sums, down, prime in zip(self.sums, _POWERS.down, PRIMES):
            p = np.uint64(prime)
            parts.append((sums[size:] + p - sums[:-size]) % p * down[: self.n - size + 1] % p)
        return parts[0] << np.uint64(31) | parts[1]

    def equal(self, start: int, other: Prefixes, other_start: int, length: int) -> bool:
        a = self.spans(np.array([start]), np.array([start + length]))
        b = other.spans(np.array([other_start]), np.array([other_start + length]))
        return bool(a[0] == b[0])

    def common_extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """How many code points from both positions on are the same."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(start, other, other_start, middle) else (low, middle - 1)
        return low

    def digest(self) -> int:
        return int(self.spans(np.array([0]), np.array([self.n]))[0])


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def sketch(prefixes: Prefixes) -> np.ndarray:
    """Per class of span hashes the smallest 32-bit value; classes without spans hold a mark of their own."""
    mixed = _mixed(prefixes.windows(SPAN))
    slots = np.full(SLOTS, _EMPTY, np.uint32)
    np.minimum.at(slots, (mixed >> np.uint64(58)).astype(np.int64) % SLOTS,
                  np.minimum(mixed & np.uint64(0xFFFFFFFF), np.uint64(_EMPTY - 1)).astype(np.uint32))
    return slots


def fingerprint(prefixes: Prefixes, slots: np.ndarray) -> str:
    """Whole-text hash, length, and the slots, as hex."""
    return f"{prefixes.digest():016x}-{prefixes.n:x}-{slots.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common spans: equal slots among those that either text fills; two empty texts are equal."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many code points of the following text (or all)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Print:
    def __init__(self, text: str) -> None:
        self.text, self.prefixes = text, Prefixes(text)
        self.slots = sketch(self.prefixes)
        self.name = fingerprint(self.prefixes, self.slots)


_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, common_edited long")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come range by range in falling id order, each range followed by a copy of the next range's first row."""
    waiting: tuple | None = None
    for batch in batches:
        out = []
        for part, ghost, number, text in zip(*(batch.column(c).to_pylist() for c in ("range", "ghost", "id", "text"))):
            here = _Print(text)
            if waiting is not None and waiting[0] == part:
                out.append(_row(waiting[1], waiting[2], here))
            waiting = None if ghost else (part, number, here)
        columns = list(zip(*out)) or [[]] * 8
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=[f.split()[0] for f in _SCHEMA.split(", ")])


def _row(number: int | None, this: _Print, following: _Print) -> tuple:
    text = edited(this.text, following.text)
    other = this if text == this.text else _Print(text)
    return (number, this.prefixes.n, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), this.name, other.name,
            likeness(this.slots, other.slots), likeness(this.slots, following.slots),
            this.prefixes.common_extension(0, other.prefixes, 0))


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """Up to ``parts - 1`` approximate quantiles of the ids."""
    points = docs.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)])).first()[0] if parts > 1 else None
    return sorted(set(points or []))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited form, and compare both and the next document by their fingerprints.

    Next is the document with the next smaller id, after the last one the first. Result: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited (the longest common
    extension of both texts from their starts). A null text is empty. Rows of one id follow each other in falling
    order of their texts, null ids come last. A single row is its own next; an empty table gives no rows; further
    columns are ignored.

    Ids are cut into ranges at quantiles; each range is one sorted run of a task, with its text streamed once. The
    driver fetches the cuts and, for each range, its first id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _ranges(rows, parts)
    # range 0 has the largest ids and null ids are in the last range
    bound = F.lit(len(cuts) + 1)
    place = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>"),
                            lambda c: c >= F.col("id")))
    ranged = rows.withColumn("range", F.when(F.col("id").isNull(), bound).otherwise(place))
    heads = (ranged.groupBy("range").agg(F.max("id").alias("id")).orderBy("range").collect())
    if not heads:
        return spark.createDataFrame([], _SCHEMA.replace("id long", f"{id_col} long", 1))
    # the first row of each range closes the range before it; that of the first closes the last
    closes = {h["range"]: heads[i - 1]["range"] for i, h in enumerate(heads)}
    wanted = {h["id"]: closes[h["range"]] for h in heads if h["id"] is not None}
    first = ranged.filter(F.col("id").isin(list(wanted)))
    if any(h["id"] is None for h in heads):
        first = first.unionByName(ranged.filter(F.col("id").isNull()))
    order = [F.col("id").desc_nulls_last(), F.col("text").desc()]
    closing = {**wanted, None: closes.get(len(cuts) + 1)}
    target = F.create_map(*[F.lit(x) for k, v in closing.items() if k is not None for x in (k, v)]) if wanted else None
    to = F.when(F.col("id").isNull(), F.lit(closing[None])).otherwise(target[F.col("id")]) if target is not None else F.lit(closing[None])
    ghosts = (first.groupBy("range", "id").agg(F.max("text").alias("text"))
              .select(to.cast("int").alias("range"), F.lit(1).alias("ghost"), "id", "text"))
    together = ranged.select("range", F.lit(0).alias("ghost"), "id", "text").unionByName(ghosts)
    run = (together.repartition(parts // 4, "range").sortWithinPartitions("range", "ghost", *order)
           .mapInArrow(_compared, _SCHEMA))
    return run.withColumnRenamed("id", id_col)

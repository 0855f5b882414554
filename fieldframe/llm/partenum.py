"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are put into bands of nearly equal size, in which a Jaccard similarity becomes a bound k on the
number of elements by which two sets differ. The domain of shingles is cut into ``n1`` parts, so that in some of
them similar sets differ by one element at most, and each of these into ``second`` parts: the sets then agree on all
but one of those. Every subset that leaves one out gives a signature, and sets that are similar enough share one.

Documents with equal sets form one class from the start. Within a bucket of one signature no pairs are spelled out:
every member is compared with one centre, and only where that leaves a bucket in several components its members are
compared across them, in blocks of bit sketches. The distance of two sketches never exceeds that of the sets, so only
pairs that it lets pass become rows, and those are decided by the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldframe.llm.common import join_groups, small, staged

#: Members of one bucket that are compared as one block.
BLOCK = 2048
#: A signature is the number of its band and so many bits of a hash: fewer bytes to shuffle, and a chance match only
#: adds a candidate.
SIGNATURE_BITS = 38
#: A sketch has at least so many bits, so that those of small sets tell more than the bound apart.
LEAST_BITS = 512
#: Bytes of text that are hashed at once.
SLICE_BYTES = 2 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C17 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


# -- sets of shingles ----------------------------------------------------------------------------------------------

@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, _U)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    return tables[0], tables[1]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of ``data``, which ends with a space."""
    code = _LOWER[data]
    space = _SPACE[code]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    size = 1 << max(16, int(len(code)).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(code) + 1, _U)
    np.cumsum(_BYTE[code] * up[: len(code)], out=total[1:])
    return start, mix((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    first = 0
    while first < len(texts):
        parts, size, last = [], 0, first
        while last < len(texts) and (size < SLICE_BYTES or last == first):
            parts.append((texts[last] or "").encode("utf-8", "surrogatepass") + b" ")
            size += len(parts[-1])
            last += 1
        start, words = _word_hashes(np.frombuffer(b"".join(parts), np.uint8))
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        cut = np.searchsorted(start, offsets)
        rolled = words.copy()
        for j in range(1, width):
            rolled = mix(rolled[:-1] * _U(0x9FB21C651E98DF25) + words[j:]) if len(rolled) > 1 else rolled[:0]
        for a, b in zip(cut[:-1], cut[1:]):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                whole = words[a:a + 1] + _U(b - a)
                for w in words[a + 1:b]:
                    whole = mix(whole * _U(0x9FB21C651E98DF25) + w)
                yield whole
            else:
                yield words[:0]
        first = last


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    if not len(elements):
        return 0, 0
    sums = (mix(elements).sum(dtype=_U), mix(elements ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
    return tuple(int(s.astype(np.int64)) for s in sums)


# -- bands and signatures ------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Band:
    number: int
    least: int
    most: int
    distance: int   # k: similar sets that meet in this band differ by at most so many elements
    parts: int      # n1
    spare: int      # at least 1 + spare first-level parts of similar sets differ by one element at most
    bits: int       # of the sketch
    second: int     # n2


@dataclass(frozen=True)
class Join:
    """Link where ``over * intersection >= under * union``, on shingles of ``width`` words."""
    width: int = 5
    under: int = 80
    over: int = 100
    second: int = 3

    def bands(self) -> list[Band]:
        return _bands(self.under, self.over, self.second)

    def of(self, n: int) -> list[Band]:
        """The bands in which a set of ``n`` elements meets others: its own, and the next if a partner can be there."""
        bands = self.bands()
        i = int(np.searchsorted([b.least for b in bands], n, side="right")) - 1
        reach = n * self.over // self.under
        return bands[i:i + 2] if reach > bands[i].most else bands[i:i + 1]


@lru_cache(maxsize=4)
def _bands(under: int, over: int, second: int) -> list[Band]:
    found, least = [], 1
    while least < 1 << 40:
        most = max(least, -(-least * over // under) - 1)
        k = (over - under) * 2 * most // (over + under)
        parts = k // 2 + 1
        smallest = max(1, least * under // over)
        empty = parts * second * math.exp(-smallest * (second - 1) / second / parts)
        spare = 0 if k == 0 else math.ceil(empty + 3 * math.sqrt(empty))
        bits = max(LEAST_BITS, 1 << (4 * k).bit_length())
        found.append(Band(len(found), least, most, k, parts + spare, spare, bits, second))
        least = most + 1
    return found


def _tagged(hashes: np.ndarray, band: Band) -> np.ndarray:
    return hashes >> _U(64 - SIGNATURE_BITS) | _U(band.number << SIGNATURE_BITS)


def signatures(elements: np.ndarray, band: Band) -> np.ndarray:
    """The signatures of one set in one band.

    Subsets without any element say nothing and would be shared by many sets. They are left out as long as no more
    first-level parts than the spare ones have such a subset; other sets give all signatures.
    """
    values = mix(elements ^ _U(0xD6E8FEB86659FD93))
    if band.distance == 0:
        return _tagged(mix(values.sum(dtype=_U, keepdims=True) + _U(band.number + 1)), band)
    second = band.second
    slots = band.parts * second
    place = ((elements >> _U(32)) % _U(band.parts)).astype(np.int64) * second + ((elements & _U(0xFFFFFFFF)) % _U(second)).astype(np.int64)
    sums = np.zeros(slots, _U)
    np.add.at(sums, place, values)
    counts = np.bincount(place, minlength=slots)
    sums, counts = sums.reshape(-1, second), counts.reshape(-1, second)
    left = sums.sum(axis=1, dtype=_U, keepdims=True) - sums
    filled = counts.sum(axis=1, keepdims=True) - counts > 0
    tags = mix(np.arange(slots, dtype=_U) + (_U(band.number + 1) << _U(32))).reshape(-1, second)
    marked = _tagged(mix(left + tags), band)
    regular = int((~filled.all(axis=1)).sum()) <= band.spare
    return marked[filled] if regular else marked.ravel()


def sketch(elements: np.ndarray, band: Band) -> np.ndarray:
    """Parity of the elements in each of ``bits`` classes; two sets differ by at least as many elements as bits."""
    odd = np.bincount((elements % _U(band.bits)).astype(np.int64), minlength=band.bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


# -- passes over the texts -----------------------------------------------------------------------------------------

def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _keys(join: Join, carried: str = "id"):
    """Set sizes and keys beside the column ``carried``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((len(s), *set_key(s)) for s in shingle_sets(batch.column("text").to_pylist(), join.width))
            columns = list(zip(*sets)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(carried), *(pa.array(c, pa.int64()) for c in columns)],
                                             names=[carried, "n", "k1", "k2"])
    return run


def _signed(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            seen: dict[tuple[int, int], int] = {}
            for batch in _slices(whole):
                ids, found = [], []
                for number, elements in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), join.width)):
                    # of equal sets in one batch the first speaks for all
                    if len(elements) and seen.setdefault(set_key(elements), number) == number:
                        ids.append(number)
                        found.append(np.concatenate([signatures(elements, b) for b in join.of(len(elements))]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(found)], names=["id", "sigs"])
    return run


def _sketched(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                rows = []
                for number, elements in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), join.width)):
                    if len(elements):
                        bands = join.of(len(elements))
                        drawn = [sketch(elements, b) for b in bands]
                        rows.append((number, *set_key(elements), bands[0].number, drawn[0], drawn[1] if len(drawn) > 1 else drawn[0][:0]))
                numbers = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*numbers, *(_lists([r[i] for r in rows]) for i in (4, 5))],
                                                 names=["id", "k1", "k2", "band", "own", "next"])
    return run


def _elements(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                sets = list(shingle_sets(batch.column("text").to_pylist(), join.width))
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), _lists(sets)],
                    names=["id", "k1", "k2", "elements"])
    return run


@lru_cache(maxsize=64)
def _all_pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _across(join: Join):
    """Pairs of one block that lie in different components and are near by size and sketch."""
    def near(group: list[tuple]) -> set[tuple[int, int]]:
        ids, sizes, comps, halves = (np.array([g[i] for g in group]) for i in range(4))
        drawn = np.stack([g[4] for g in group])
        n, found = len(group), set()
        # a small block is compared at once, a larger one row by row
        for i, j in [_all_pairs(n)] if n <= 64 else ((np.full(n - k - 1, k), np.arange(k + 1, n)) for k in range(n - 1)):
            # in a block of two parts only pairs between them are new
            fit = (comps[i] != comps[j]) & ((halves[i] != halves[j]) | (halves[i] < 0))
            fit &= np.minimum(sizes[i], sizes[j]) * join.over >= np.maximum(sizes[i], sizes[j]) * join.under
            if fit.any():
                i, j = i[fit], j[fit]
                apart = np.bitwise_count(drawn[i] ^ drawn[j]).sum(axis=1, dtype=np.int64)
                fit = apart * (join.over + join.under) <= (sizes[i] + sizes[j]) * (join.over - join.under)
                a, b = ids[i[fit]], ids[j[fit]]
                found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, done = None, [], set()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sig", "low", "high", "rep", "n", "component", "half", "band")]
            lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy().view(np.uint64)) for c in ("own", "next")]
            for row, (sig, low, high, *member, band) in enumerate(zip(*columns)):
                if (sig, low, high) != key:
                    if len(group) > 1:
                        done |= near(group)
                    key, group = (sig, low, high), []
                # a set of the band below takes part with its sketch for this one
                offsets, values = lists[0 if band == sig >> SIGNATURE_BITS else 1]
                group.append((*member, values[offsets[row]:offsets[row + 1]].copy()))
            yield _pair_batch(done)
            done.clear()
        if len(group) > 1:
            done |= near(group)
        yield _pair_batch(done)
    return run


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    ordered = sorted(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in ordered], pa.int64()) for i in (0, 1)], names=["a", "b"])


# -- the join ------------------------------------------------------------------------------------------------------

def components(links: DataFrame) -> DataFrame:
    """(node, component) of a graph of ``links(a, b)``; component is the smallest node of it.

    Alternating large and small stars: each round hangs the neighbours of a node on the smallest of them, until
    nothing changes. A node with many neighbours meets them by a minimum, combined before the shuffle, and a join.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(hung.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _near_sizes(join: Join, a: Column, b: Column) -> Column:
    return (F.least(a, b) * join.over >= F.greatest(a, b) * join.under)


def _near(pairs: DataFrame, details: DataFrame, join: Join) -> DataFrame:
    """Those of ``pairs(a, b)`` that size and sketch let pass, as (a, b, n_a, n_b)."""
    sketches = details.select("id", "n", "band", "own", "next")
    left, right = ([F.col(c).alias(f"{c}_{s}") for c in sketches.columns] for s in "ab")
    drawn = (pairs.join(sketches.select(*left), F.col("a") == F.col("id_a")).join(sketches.select(*right), F.col("b") == F.col("id_b")))
    x = F.when(F.col("band_a") < F.col("band_b"), F.col("next_a")).otherwise(F.col("own_a"))
    y = F.when(F.col("band_b") < F.col("band_a"), F.col("next_b")).otherwise(F.col("own_b"))
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    most = F.floor((F.col("n_a") + F.col("n_b")) * (join.over - join.under) / (join.over + join.under))
    return (drawn.filter((F.abs(F.col("band_a") - F.col("band_b")) <= 1) & _near_sizes(join, F.col("n_a"), F.col("n_b")) & (apart <= most))
            .select("a", "b", "n_a", "n_b"))


def _linked(pairs: DataFrame, details: DataFrame, known: DataFrame, join: Join) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link; the sets are read again for the documents of near pairs only."""
    near = staged(_near(pairs, details, join), "near-pairs")
    asked = staged(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-documents")
    sets = (known.join(small(asked), "id").mapInArrow(_elements(join), "id long, k1 long, k2 long, elements array<long>")
            .join(small(staged(details.join(asked, "id").select("id", "k1", "k2"), "near-keys")), ["id", "k1", "k2"]).dropDuplicates(["id"]))
    sets = staged(sets.select("id", "elements"), "near-sets")
    compared = (near.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
                .join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
                .withColumn("common", F.size(F.array_intersect("x", "y"))))
    return compared.filter(F.col("common") * join.over >= (F.col("n_a") + F.col("n_b") - F.col("common")) * join.under).select("a", "b")


def _unsettled_pairs(unsettled: DataFrame, details: DataFrame, join: Join) -> DataFrame:
    """Near pairs (a, b) between the components that meet in a bucket of ``unsettled(sig, rep, n, component)``.

    A bucket of more than ``BLOCK`` members is cut into parts, and every two parts meet in a task of their own.
    """
    parts = unsettled.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    drawn = unsettled.join(parts, "sig").join(details.select(F.col("id").alias("rep"), "band", "own", "next"), "rep")
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    placed = drawn.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = placed.select("sig", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "rep", "n",
                          "component", "band", "own", "next",
                          F.when(F.col("part") == F.col("with"), F.lit(-1)).otherwise(F.col("part")).alias("half"))
    # the cell of a part with itself has one row a member, the cell of two parts has the members of both
    shuffled = cells.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    return shuffled.mapInArrow(_across(join), "a long, b long")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _told_apart(rows: DataFrame, keyed: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (id, text), the sets of their ids, and what stands for ids with several sets.

    Such an id is replaced by a number of its own for each of its sets, larger than any id or smaller than all. The
    third table says (id, own, digest): the id, its numbers, and the digests of the texts; None if there is none such.
    """
    known = rows.filter(F.col("id").isNotNull())
    sets = keyed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    nodes = sets.groupBy("id").agg(F.min(F.struct("k1", "k2", "n")).alias("s"), F.max(F.struct("k1", "k2", "n")).alias("t"))
    mixed = staged(nodes.filter("s <> t").select("id"), "mixed-ids")
    if mixed.isEmpty():
        return known, nodes.select("id", "s.*"), None
    several = known.join(small(mixed), "id").select(F.struct("id", F.sha2("text", 256).alias("digest")).alias("own_id"), "text")
    found = staged(several.mapInArrow(_keys(join, "own_id"), "own_id struct<id: long, digest: string>, n long, k1 long, k2 long")
                   .filter("n > 0").select("own_id.id", "own_id.digest", "n", "k1", "k2").distinct(), "mixed-sets")
    each = found.select("id", "k1", "k2", "n").distinct()
    low, high, count = *keyed.agg(F.min("id"), F.max("id")).first(), each.count()
    first = high + 1 if high < (1 << 63) - 1 - count else low - count
    # numbers by partition and place in it, written so that they stay as they are
    loose = staged(each.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "mixed-places")
    sizes = loose.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("begin"))
    before = Window.partitionBy(F.least(F.abs("part"), F.lit(0))).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", "begin", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    numbered = staged(loose.join(F.broadcast(begins), "part").select(
        "id", "k1", "k2", "n", (F.col("place") - F.col("begin") + F.col("before") + F.lit(first)).alias("own")), "mixed-numbers")
    names = staged(found.join(numbered, ["id", "k1", "k2", "n"]).select("id", "own", "digest"), "mixed-names")
    renamed = (known.join(small(mixed), "id").withColumn("digest", F.sha2("text", 256))
               .join(names, ["id", "digest"]).select(F.col("own").alias("id"), "text"))
    apart = known.join(small(mixed), "id", "left_anti").unionByName(renamed)
    own_sets = numbered.select(F.col("own").alias("id"), "k1", "k2", "n")
    return apart, nodes.join(small(mixed), "id", "left_anti").select("id", "s.*").unionByName(own_sets), names


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """Per row of ``docs``: id, n_shingles (size of its set), component_id (smallest id that links reach, itself included).

    Words are what stands between spaces, tabs and line ends, after lower-casing A-Z; a set holds the distinct
    shingles of ``join.width`` words, the whole sequence if there are fewer words. Without text or words the set is
    empty and linked with nothing. Sets are held as 64-bit hashes. Rows of one id are one document, which has the
    links of all its texts. Rows with a null id keep their n_shingles and have a null
    component. Further columns are ignored, an empty table gives no rows. Several steps are written as they come.
    """
    keyed, reached, names = _reached(docs, id_col, text_col, join)
    if names is not None:
        # an id with several texts ties the groups of its texts together
        mixed = names.select("id", "own").distinct()
        ids = reached.join(mixed.select(F.col("id").alias("real"), F.col("own").alias("id")), "id", "left").select(F.coalesce("real", "id").alias("id"), "component_id").distinct()
        ids = staged(ids, "ids-of-groups")
        least = ids.join(small(mixed.select("id").distinct()), "id").groupBy("id").agg(F.min("component_id").alias("a"))
        ties = ids.join(least, "id").select(F.col("component_id").alias("b"), "a").filter("a <> b")
        tied = components(ties)
        merged = ids.join(tied.withColumnRenamed("node", "component_id"), "component_id", "left").select("id", F.coalesce("component", "component_id").alias("group")).distinct()
        smallest = merged.groupBy("group").agg(F.min("id").alias("component_id"))
        reached = staged(merged.join(smallest, "group").select("id", "component_id"), "groups")
    return (keyed.select("id", F.col("n").alias("n_shingles")).join(reached, "id", "left")
            .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", F.col("id")).alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """What to drop so that of each group of linked texts the document with the smallest id stays: (id, digest).

    A null ``digest`` stands for all texts of the id; else only the text with this SHA-256 goes, as the id has others
    too. Of several near texts under the smallest id one stays. Null ids and sets without words are in no group.
    """
    _, reached, names = _reached(docs, id_col, text_col, join)
    if names is None:
        return reached.filter("component_id <> id").select("id", F.lit(None).cast("string").alias("digest"))
    named = reached.join(names.select(F.col("id").alias("real"), F.col("own").alias("id"), "digest"), "id", "left").select(
        F.coalesce("real", "id").alias("real"), "id", "digest", "component_id")
    stays = named.groupBy("component_id").agg(F.min(F.struct("real", "id")).alias("stays"))
    return named.join(stays, "component_id").filter(F.col("stays.id") != F.col("id")).select(F.col("real").alias("id"), "digest")


def _reached(docs: DataFrame, id_col: str, text_col: str, join: Join) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sets of all rows (id, n, k1, k2), (id, component_id) of all sets told apart, and the names of ids told apart."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = staged(rows.mapInArrow(_keys(join), "id long, n long, k1 long, k2 long"), "set-keys")
    known, nodes, names = _told_apart(rows, keyed, join)
    # the class of equal sets goes by its smallest id
    smallest = staged(nodes.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("ids")), "set-names")
    classes = staged(join_groups(nodes, smallest, ["k1", "k2"], "ids").select("id", "rep", "n", "k1", "k2"), "set-classes")

    # copies need no signatures of their own; where they are too many for a broadcast, they are merged further down
    copies = staged(classes.filter("id <> rep").select("id"), "set-copies")
    few = small(copies)
    speakers = known.join(few, "id", "left_anti") if few is not copies else known
    lists = speakers.mapInArrow(_signed(join), "id long, sigs array<long>")
    signed = lists.select("id", F.explode("sigs").alias("sig"))
    shared = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("sig")
    met = signed.join(shared, "sig").join(classes.select("id", "rep", "n"), "id").select("sig", "rep", "n").distinct()
    buckets = staged(met, "buckets")
    sizes = buckets.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = staged(buckets.join(sizes, "sig"), "buckets")

    members = staged(buckets.select(F.col("rep").alias("id")).distinct(), "bucket-members")
    own = classes.filter("id = rep").join(members, "id").select("id", "n", "k1", "k2")
    details = staged(known.join(small(members), "id").mapInArrow(
        _sketched(join), "id long, k1 long, k2 long, band int, own array<long>, next array<long>")
        .join(own, ["id", "k1", "k2"]).dropDuplicates(["id"]), "set-sketches")

    # the centre of a bucket is the member that meets most others in all of its buckets
    popular = buckets.groupBy("rep").agg(F.sum("size").alias("popularity"))
    placed = staged(buckets.join(popular, "rep"), "placed-members")
    centres = placed.groupBy("sig").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("least"))).alias("c")).select("sig", (-F.col("c.least")).alias("centre"))
    stars = staged(placed.join(centres, "sig").filter("rep <> centre").select(*_pairs(F.col("rep"), F.col("centre"))).distinct(), "star-pairs")
    links = staged(_linked(stars, details, known, join), "star-links")
    found = staged(components(links), "star-components")

    named = buckets.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", "n", F.coalesce("component", "rep").alias("component"))
    named = staged(named, "named-members")
    open_sigs = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    unsettled = staged(named.join(open_sigs, "sig"), "unsettled-members")
    if unsettled.limit(1).count():
        across = _unsettled_pairs(unsettled, details, join)
        more = _linked(staged(across.distinct(), "cross-pairs").join(stars, ["a", "b"], "left_anti"), details, known, join)
        found = staged(components(links.unionByName(more)), "components")
    reached = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component_id"))
    return keyed, reached, names

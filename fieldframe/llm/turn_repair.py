"""Repair of conversation structure: the cheapest edits that give legal roles, by a parallel Viterbi pass with rank convergence.

Roles are legal when their initials read ``(s?(ua)+)?``. The state before a row is what the roles so far allow next, and the
cost vector of a place holds, for each state, the least cost of everything behind it. Vectors are worked backwards over the
rows; a row is a linear map of (min, +), and after few rows vectors from different ends differ by a constant only. So

* the rows are dealt by ranges of (conversation, turn) and cut into pieces of bounded size; a conversation within one piece is
  repaired where it lies, all others, a few for each range or very long ones, go on piece by piece;
* each of their pieces starts from a speculative vector at its end, as if the conversation ended there;
* fix-up passes hand every piece the vector at the start of the next one. A piece whose vector at the end changed by more
  than a constant runs again, beside the earlier run, until the two differ by a constant only: what lies before keeps its
  vectors. Passes end when no piece changed. Rows that keep vectors apart for ever are possible (long runs of foreign roles);
  conversations unsettled after ``PASSES`` are settled by the matrices of their pieces, one row a piece;
* the exit state for each entry state of every piece is chained, and from its entry state and its vectors each piece traces the
  least audit: at every place the first letter, in order of D, I, K, R, that keeps to the least cost.

Costs are exact integers; a vector may be lifted by a constant, which changes no choice, and costs are added up from the audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldframe.llm.common import staged

#: A piece has at most this many rows, and about so many characters; passes before matrices settle what is left.
PIECE_ROWS, PIECE_CHARS, PASSES = 4_096, 4_000_000, 6
#: Fixed values of the task: costs of edits, and characters that count as blank or as an end.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a new user or assistant row, which is the only one that fits.
_TURNED = (USER, USER, ASSISTANT, USER)
#: The state after a kept row, by state and initial.
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_INITIALS = " sua"
_FAR = 1 << 40
#: Cost vector behind the last row: nothing, or the rows that have to be put in.
END = (0, 2 * INSERT, INSERT, 0)
_TABLE_SIZE = 50_000

Vector = tuple[int, int, int, int]


def code_of(role: str, text: str) -> int:
    """0 for a blank row, else 1 + the initial (other, s, u, a) + 4 for a truncated text."""
    told = text.strip(BLANK)
    return 1 + max(0, _INITIALS.find(role[:1] or " ")) + 4 * (told[-1] not in ENDS) if told else 0


def _before(code: int, v: Vector) -> Vector:
    """The vector before a row from the one behind it."""
    if code == 0:
        return tuple(x + DELETE for x in v)
    initial, cut = _INITIALS[(code - 1) % 4], CUT * (code > 4)
    best = [min(v[s] + DELETE, v[_TURNED[s]] + REROLE + cut) for s in range(4)]
    for s in range(4):
        to = _KEPT.get((s, initial))
        if to is not None:
            best[s] = min(best[s], v[to] + cut)
    return _inserting(best)


def _inserting(best: list[int]) -> Vector:
    """Rows may be put in at any place; two at most are of use."""
    u, a = min(best[USER], best[ASSISTANT] + INSERT), min(best[ASSISTANT], best[USER] + INSERT)
    return min(best[START], u + INSERT), min(best[SYSTEM], u + INSERT), u, a


def _relative(v: Vector) -> Vector:
    least = min(v)
    return tuple(x - least for x in v)


def run_back(codes: bytes, end: Vector) -> Vector:
    """The vector at the start of a piece, lifted so that its least entry is 0."""
    for code in reversed(codes):
        end = _before(code, end)
    return _relative(end)


def run_again(codes: bytes, old_end: Vector, end: Vector, old_start: Vector) -> Vector:
    """The vector at the start for a new end; stops where the new vector is the old one but for a constant."""
    for code in reversed(codes):
        if _relative(old_end) == _relative(end):
            return old_start
        old_end, end = _before(code, old_end), _before(code, end)
    return _relative(end)


def matrix_of(codes: bytes) -> list[int]:
    """The piece as a map of (min, +): for each unit vector at its end the vector at its start."""
    out = []
    for k in range(4):
        v = tuple(0 if s == k else _FAR for s in range(4))
        v = _inserting(list(v))
        for code in reversed(codes):
            v = _before(code, v)
        out += [min(x, _FAR) for x in v]
    return out


def trace(codes: bytes, end: Vector, state: int, last: bool) -> tuple[str, int]:
    """The least audit of a piece from ``state`` on, and the state behind it; ``last`` adds the rows put in at the very end."""
    vectors = [end]
    for code in reversed(codes):
        vectors.append(_before(code, vectors[-1]))
    vectors.reverse()
    letters = []
    for i, code in enumerate(codes):
        here, after = vectors[i], vectors[i + 1]
        cut = CUT * (code > 4)
        while True:
            left = here[state]
            if left == after[state] + DELETE:
                letters.append("D")
                break
            if left == here[_TURNED[state]] + INSERT:
                letters.append("I")
                state = _TURNED[state]
                continue
            to = _KEPT.get((state, _INITIALS[(code - 1) % 4])) if code else None
            if to is not None and left == after[to] + cut:
                letters.append("K")
                state = to
                break
            letters.append("R")
            state = _TURNED[state]
            break
    while last and state in (SYSTEM, USER):
        letters.append("I")
        state = _TURNED[state]
    return "".join(letters), state


def applied(audit: str, rows: list[tuple[str, str]], state: int) -> list[dict[str, str]]:
    """The repaired rows: role, text, and the edit that made them."""
    out, at = [], 0
    for letter in audit:
        if letter != "I":
            role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        to = _KEPT[state, role[:1]] if letter == "K" else _TURNED[state]
        if letter != "K":
            role = "user" if to == USER else "assistant"
        out.append({"role": role, "text": "" if letter == "I" else text, "edit": letter})
        state = to
    return out


def audit_cost(audit: str, codes: bytes) -> int:
    cost, at = 0, 0
    for letter in audit:
        cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter]
        if letter != "I":
            cost += CUT * (letter != "D" and codes[at] > 4)
            at += 1
    return cost


_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("role", "text", "edit")])
_PIECE = [("piece", "long"), ("whole", "boolean"), ("rows", "long"), ("first_turn", "long"), ("last_turn", "long"), ("turns", "long"),
          ("first_initial", "string"), ("last_initial", "string"), ("illegal", "long")]
_DONE = [("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("cost", "long"), ("audit", "string")]
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _measured(held: list[tuple]) -> dict:
    """What a piece of rows (turn, role, text) adds to the report, edits aside."""
    turns, initials = [t for t, _, _ in held if t is not None], [r[:1] for _, r, _ in held]
    return {"rows": len(held), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
            "first_initial": initials[0] if held else None, "last_initial": initials[-1] if held else None,
            "illegal": sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))}


def _faults(codes: bytes, duplicates: int) -> dict:
    return {"blank": codes.count(0) - duplicates, "duplicate": duplicates, "truncated": sum(c > 4 for c in codes)}


def _pieces(schema: pa.Schema):
    """Conversations within one piece, repaired; pieces of others with the codes, digests and texts of their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits: dict[bytes, tuple[str, int]] = {}
        out: list[dict] = []
        held, chars, number, key, conv, part, first, cut = [], 0, 0, None, None, 0, True, False

        def close(whole: bool) -> None:
            nonlocal held, chars, number
            row = {"conv": key, "id": conv, "piece": (part << 33) + number, "whole": whole, **_measured(held)}
            codes = bytes(code_of(r, t) for _, r, t in held)
            if whole:
                seen: set[tuple[str, str]] = set()
                again = []
                for i, (_, role, text) in enumerate(held):
                    if codes[i] and (role, text) in seen:
                        again.append(i)
                    seen.add((role, text))
                codes = _without(codes, again)
                if codes not in audits:
                    if len(audits) >= _TABLE_SIZE:
                        audits.clear()
                    audits[codes] = trace(codes, END, START, True)[0], 0
                audit = audits[codes][0]
                row |= _faults(codes, len(again)) | {"audit": audit, "cost": audit_cost(audit, codes), "repaired": applied(audit, [h[1:] for h in held], START)}
            else:
                row |= {"codes": codes, "told": [{"role": r, "text": t} for _, r, t in held],
                        "digests": [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() if c else None for c, (_, r, t) in zip(codes, held)]}
            out.append(row)
            held, chars, number = [], 0, number + 1

        waiting = 0
        for batch in batches:
            for k, c, turn, role, text, alive, p in zip(*[batch.column(n).to_pylist() for n in ("conv", "id", "turn", "role", "text", "alive", "part")]):
                if k != key:
                    if key is not None:
                        close(not first and not cut)
                        first = False
                    key, conv, part, cut = k, c, p, False
                if alive:
                    if len(held) >= PIECE_ROWS or chars >= PIECE_CHARS:
                        close(False)
                        cut = True
                    held.append((turn, role, text))
                    chars += len(text)
                    waiting += len(text)
                if len(out) >= 5_000 or waiting > PIECE_CHARS and out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    waiting = 0
        if key is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _without(codes: bytes, again: list[int]) -> bytes:
    changed = bytearray(codes)
    for i in again:
        changed[i] = 0
    return bytes(changed)


def _udf(function: Callable, kind: str):
    """A function of plain values over Arrow batches."""
    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*values) for values in zip(*columns)])
    return run


def _vector(values) -> Vector:
    return tuple(int(x) for x in values)


def _settled(pieces: DataFrame) -> DataFrame:
    """(conv, piece, next, codes, end, start): the vectors of all pieces once fix-up passes change none of them."""
    end = F.array(*[F.lit(x).cast("long") for x in END])
    back = _udf(lambda codes, e: list(run_back(codes, _vector(e))), "array<long>")
    again = _udf(lambda codes, old, new, start: list(run_again(codes, _vector(old), _vector(new), _vector(start))), "array<long>")
    following = F.lead("piece").over(Window.partitionBy("conv").orderBy("piece"))
    now = staged(pieces.select("conv", "piece", following.alias("next"), "codes", end.alias("end")).withColumn("start", back("codes", "end")), "repair-pass")
    for _ in range(PASSES):
        behind = now.select("conv", F.col("piece").alias("next"), F.col("start").alias("given"))
        handed = now.join(behind, ["conv", "next"], "left").withColumn("given", F.coalesce("given", end))
        differ = F.col("given") != F.transform("end", lambda x: x - F.array_min("end"))
        if handed.filter(differ).isEmpty():
            return now
        moved = handed.filter(differ).withColumn("start", again("codes", "end", "given", "start"))
        kept = handed.filter(~differ)
        now = staged(moved.unionByName(kept).select("conv", "piece", "next", "codes", F.col("given").alias("end"), "start"), "repair-pass")
    behind = now.select("conv", F.col("piece").alias("next"), F.col("start").alias("given"))
    open_ = now.join(behind, ["conv", "next"], "left").filter(F.col("given") != F.transform("end", lambda x: x - F.array_min("end"))).select("conv").distinct()
    left = now.join(open_, "conv", "left_semi").withColumn("matrix", _udf(lambda codes: matrix_of(codes), "array<long>")("codes"))

    def chain(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("piece", ascending=False)
        v, ends = END, []
        for m in of["matrix"]:
            ends.append([int(x) for x in v])
            v = _relative(tuple(min(int(m[4 * k + s]) + v[k] for k in range(4)) for s in range(4)))
        return pd.DataFrame({"conv": of["conv"], "piece": of["piece"], "end": ends})

    exact = left.select("conv", "piece", "matrix").groupBy("conv").applyInPandas(chain, "conv string, piece long, end array<long>")
    mended = left.drop("end", "start", "matrix").join(exact, ["conv", "piece"])
    return staged(now.join(open_, "conv", "left_anti").drop("start").unionByName(mended), "repair-pass")


def _entries(vectors: DataFrame) -> DataFrame:
    """(conv, piece, codes, end, last, state): the state in which each piece is entered; one row a piece is chained."""
    exits = _udf(lambda codes, end: [trace(codes, _vector(end), s, False)[1] for s in range(4)], "array<int>")

    def chain(of: pd.DataFrame) -> pd.DataFrame:
        of = of.sort_values("piece")
        state, entered = START, []
        for to in of["exits"]:
            entered.append(state)
            state = int(to[state])
        return pd.DataFrame({"conv": of["conv"], "piece": of["piece"], "state": entered})

    maps = vectors.select("conv", "piece", exits("codes", "end").alias("exits"))
    entered = maps.groupBy("conv").applyInPandas(chain, "conv string, piece long, state int")
    return vectors.select("conv", "piece", "codes", "end", F.col("next").isNull().alias("last")).join(entered, ["conv", "piece"])


def _spanning(pieces: DataFrame) -> DataFrame:
    """The pieces of conversations that lie in several pieces, repaired."""
    keys = pieces.select("conv", "piece", F.posexplode("digests").alias("at", "digest")).filter("digest IS NOT NULL")
    place = F.struct("piece", "at")
    firsts = keys.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = (keys.join(firsts, ["conv", "digest"]).filter(place != F.col("first")).groupBy("conv", "piece").agg(F.collect_list("at").alias("again")))
    strip = _udf(lambda codes, at: _without(codes, list(at)), "binary")
    rows = staged(pieces.join(again, ["conv", "piece"], "left").withColumn("again", F.coalesce("again", F.array().cast("array<int>")))
                  .withColumn("codes", strip("codes", "again")).drop("digests"), "repair-pieces")
    entries = _entries(_settled(rows.select("conv", "piece", "codes")))
    joined = rows.drop("codes").join(entries, ["conv", "piece"])
    kept = [f for f in pieces.schema if f.name in ("id", *dict(_PIECE))]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in _DONE)), T.StructField("repaired", T.ArrayType(_ROW))])
    arrow = to_arrow_schema(schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                audit, _ = trace(row["codes"], _vector(row["end"]), row["state"], row["last"])
                told = [(r["role"], r["text"]) for r in row["told"]]
                row |= _faults(row["codes"], len(row["again"])) | {"audit": audit, "cost": audit_cost(audit, row["codes"]), "repaired": applied(audit, told, row["state"])}
                yield pa.RecordBatch.from_pylist([row], arrow)
    return joined.mapInArrow(finish, schema)


def repair(turns: DataFrame, alive: Column | None = None) -> DataFrame:
    """Repair conversations of (conv_id, turn, role, text); one row for each piece of a conversation.

    Returns conv_id, piece (pieces of one conversation follow each other in this order), whole (the conversation is in this one
    piece), rows, first_turn, last_turn, turns (distinct), first_initial, last_initial, illegal (pairs within the piece), blank,
    duplicate, truncated, cost, audit, and ``repaired``, the rows after repair with the edit of each (K, R or I).
    Rows where ``alive`` is false count for nothing but their conversation, which is then returned with no rows. Null
    roles and texts are one space, null turns come first, a null conv_id is a conversation of its own. Rows of one turn are ordered by role,
    by the first 200 characters of their text and by its hash; equal rows are duplicates of each other. Further columns are
    ignored, an empty table gives no rows. A piece holds at most ``PIECE_ROWS`` rows and little more than ``PIECE_CHARS`` characters (one text
    may be longer), so no task holds a conversation.
    """
    plain = turns.select(
        F.col("conv_id").alias("id"), F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(True) if alive is None else alive).alias("alive"), F.monotonically_increasing_id().alias("_row"))
    order = ["conv", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 200), F.xxhash64("text"), "_row"]
    dealt = plain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long")).drop("_row")
    told = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([
        T.StructField("conv", T.StringType()), T.StructField("id", plain.schema["id"].dataType),
        *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in _PIECE + _DONE)), T.StructField("repaired", T.ArrayType(_ROW)),
        T.StructField("codes", T.BinaryType()), T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("told", told)])
    found = staged(dealt.mapInArrow(_pieces(to_arrow_schema(schema)), schema), "repair")
    whole = found.filter("whole").drop("conv", "codes", "digests", "told")
    across = _spanning(found.filter("NOT whole").drop(*[n for n, _ in _DONE], "repaired"))
    return whole.unionByName(across).withColumnRenamed("id", "conv_id")


def _gaps(first: Column, last: Column, turns: Column) -> Column:
    return F.coalesce(last - first + 1 - turns, F.lit(0)).cast("long")


def _line(row: Column) -> Column:
    return F.concat(row["role"], F.lit(":"), row["text"])


def summaries(pieces: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is that of the repaired rows as ``role:text``, joined by newlines; over several pieces it is carried from piece
    to piece as they stream by in order, so one task digests a long conversation, holding one piece at a time.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = pieces.filter("whole").select(
        "conv_id", _gaps(F.col("first_turn"), F.col("last_turn"), F.col("turns")).alias("gaps"), *counts, "audit",
        F.sha2(F.array_join(F.transform("repaired", _line), "\n"), 256).alias("repaired_sha256"))
    schema = to_arrow_schema(whole.schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, digest, audit = None, None, []

        def done() -> pa.RecordBatch:
            first, last = total.pop("first_turn"), total.pop("last_turn")
            gaps = 0 if first is None else last - first + 1 - total.pop("turns")
            total.pop("turns", None)
            total.pop("last_initial")
            total.pop("written")
            return pa.RecordBatch.from_pylist([{**total, "gaps": gaps, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if total is None or row["conv_id"] != total["conv_id"]:
                    if total is not None:
                        yield done()
                    total = {"conv_id": row["conv_id"], **dict.fromkeys(counts, 0), "turns": 0, "first_turn": None, "last_turn": None, "last_initial": None, "written": 0}
                    digest, audit = hashlib.sha256(), []
                for c in counts:
                    total[c] += row[c]
                if row["rows"]:
                    total["illegal"] += total["last_initial"] is not None and (total["last_initial"], row["first_initial"]) not in _LEGAL
                    total["last_initial"] = row["last_initial"]
                if row["first_turn"] is not None:
                    total["turns"] += row["turns"] - (row["first_turn"] == total["last_turn"])
                    total["first_turn"] = row["first_turn"] if total["first_turn"] is None else total["first_turn"]
                    total["last_turn"] = row["last_turn"]
                audit.append(row["audit"])
                for told in row["repaired"]:
                    digest.update(f"{chr(10) * (total['written'] > 0)}{told['role']}:{told['text']}".encode())
                    total["written"] += 1
        if total is not None:
            yield done()

    across = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(fold, whole.schema)
    return whole.unionByName(across)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Rows as damaged by the remainder of a checksum of ``conv_id:turn`` (rows repeated, texts and roles changed), and the test for rows not dropped."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    rows = turns.select("conv_id", "turn", "role", "text", kind.alias("kind")).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), "kind",
        F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows, F.col("kind") != 0

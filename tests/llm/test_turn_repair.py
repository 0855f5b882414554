import functools
import hashlib
import random
import zlib

import pytest

from fieldframe.llm import conversation_queries, turn_repair  # noqa: F401
from fieldframe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
#: state -> {initial: next state}; S before any row, s, u, a after that role
FOLLOWS = {"S": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(rows):
    """(cost, audit, roles) by searching whole audits: rows are (initial, must go, truncated)."""
    @functools.cache
    def best(i, state, room):
        found = [(0, "", ())] if i == len(rows) and state in "Sa" else []
        new = {"S": "u", "s": "u", "u": "a", "a": "u"}[state]
        if room:
            found.append(add(3, "I", new, best(i, new, room - 1)))
        if i < len(rows):
            initial, gone, cut = rows[i]
            found.append(add(4, "D", None, best(i + 1, state, 3)))
            if not gone:
                if initial in FOLLOWS[state]:
                    found.append(add(3 * cut, "K", "=", best(i + 1, FOLLOWS[state][initial], 3)))
                found.append(add(3 + 3 * cut, "R", new, best(i + 1, new, 3)))
        return min(found) if found else (10**9, "", ())

    def add(cost, letter, role, rest):
        return cost + rest[0], letter + rest[1], (role, *rest[2])
    return best(0, "S", 3)


def brute(rows, damage=True):
    """conv_id -> expected summary."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        held = []
        for c, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = (" " if role is None else role), (" " if text is None else text)
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
            if kind:
                text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
                held += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in held:
            told = text.strip(BLANK)
            faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, roles = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(held, faults)))
        turns = {r[0] for r in held if r[0] is not None}
        left, lines = iter(held), []
        for letter, role in zip(audit, roles):
            row = next(left) if letter != "I" else None
            if letter != "D":
                lines.append(f"{row[1] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[role]}:{row[2] if row else ''}")
        pairs = zip(held, held[1:])
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def same(frame, want):
    got = frame.collect()
    assert len(got) == len(want)
    for r in got:
        r = r.asDict()
        conv = r.pop("conv_id")
        assert r == want[conv], (conv, r, want[conv])


def sample(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", None, "a b.", "long " * 90 + rng.choice([".", "x"])]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ["user", "assistant"][turn % 2]
            role = rng.choice(["system", "tool", "", None, "user"]) if rng.random() < 0.2 else role
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, f"{rng.choice(texts)}" if rng.random() < 0.5 else f"t{turn} ends."))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"PIECE_ROWS": 3}, {"PIECE_ROWS": 2, "PASSES": 1}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(turn_repair, name, value)
    rows = sample(1, 60, 14) + [(None, 0, "user", "null id."), (None, 1, "assistant", "Yes."), (None, 2, "tool", "ok"), (None, 2, "tool", "ok")]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cost", "2 AS piece", "3 AS `a.b`", "4 AS part", "5 AS id")
    out = turn_repair.summaries(turn_repair.repair(*turn_repair.damaged(table)))
    same(out, brute(rows))


def test_long_runs_that_never_converge(spark, monkeypatch):
    """Foreign roles keep vectors apart; the matrices of the pieces settle them."""
    monkeypatch.setattr(turn_repair, "PIECE_ROWS", 2)
    monkeypatch.setattr(turn_repair, "PASSES", 2)
    rows = [(1, i, "tool", f"{i}.") for i in range(31)] + [(2, i, "tool", f"{i}.") for i in range(30)] + [(3, i, "tool", "same.") for i in range(25)]
    out = turn_repair.summaries(turn_repair.repair(spark.createDataFrame(rows, SCHEMA)))
    same(out, brute(rows, damage=False))


def test_vectors_of_pieces():
    rng = random.Random(3)
    for _ in range(200):
        codes = bytes(rng.randint(0, 8) for _ in range(rng.randint(0, 12)))
        m = turn_repair.matrix_of(codes)
        ends = [turn_repair.END, *(turn_repair._inserting([rng.randint(0, 9) for _ in range(4)]) for _ in range(3))]
        for end in ends:
            start = turn_repair.run_back(codes, end)
            assert turn_repair._relative(tuple(min(m[4 * k + s] + end[k] for k in range(4)) for s in range(4))) == start
            for old in ends:
                assert turn_repair.run_again(codes, old, end, turn_repair.run_back(codes, old)) == start


def test_empty_dropped_and_long(spark):
    assert turn_repair.summaries(turn_repair.repair(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    rows = [(1, dropped, "user", "gone."), (2, None, None, None), (3, 0, "user", "x" * 1_000_000), (3, 5, "assistant", "y" * 1_000_000 + ".")]
    same(turn_repair.summaries(turn_repair.repair(*turn_repair.damaged(spark.createDataFrame(rows, SCHEMA)))), brute(rows))


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", "Ask?")]
    got = turn_repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["cost"] for r in got) == brute(rows, damage=False)[1]["cost"]
    assert "".join(x["role"][0] for r in got for x in r["repaired"]) in ("", "ua", "uaua")


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op12_conversation_repair"](spark, sf), brute(rows))

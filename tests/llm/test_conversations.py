"""Conversation repair against an exhaustive search over all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from lodestar.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?")


def repaired(rows, audit):
    """Roles and texts after the edits, by the initials so far; None if an edit is not allowed."""
    out, queue = [], list(rows)
    for e in audit:
        wanted = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((wanted, ""))
            continue
        if not queue:
            return None
        role, text, must_go, _ = queue.pop(0)
        if e != "D" and must_go:
            return None
        if e != "D":
            out.append((wanted if e == "R" else role, text))
    return None if queue else out


def exhaustive(rows, inserts):
    """Cheapest cost and least audit among all audits with at most ``inserts`` inserts before each place."""
    best = None
    gaps = ["I" * k for k in range(inserts + 1)]
    for edits in product("DKR", repeat=len(rows)):
        for added in product(gaps, repeat=len(rows) + 1):
            audit = "".join(g + e for g, e in zip(added, [*edits, ""]))
            out = repaired(rows, audit)
            if out is None or not GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                continue
            cost = 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D")
            cost += sum(3 for e, r in zip(edits, rows) if e != "D" and r[3])
            best = min(best or (cost, audit), (cost, audit))
    return best


def lattice(rows):
    return [(role[:1], must_go, truncated) for role, _, must_go, truncated in rows]


def random_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "usher"]
    kinds = [(False, False)] * 4 + [(True, False), (False, True)]
    return [(rng.choice(roles), f"t{k}", *rng.choice(kinds)) for k in range(n)]


def test_search_equals_all_edits():
    rng = random.Random(3)
    for _ in range(150):
        rows = random_rows(rng, rng.randrange(5))
        assert C.cheapest(lattice(rows)) == exhaustive(rows, 2 if len(rows) < 4 else 1), rows


def forward_only(rows):
    """Least (cost, audit) by one pass over rows; a row's state keeps its best label."""
    def inserted(labels):
        for _ in range(4):
            for s, (cost, audit) in list(labels.items()):
                to = C.ADDED[s]
                labels[to] = min(labels.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return labels

    labels = inserted({0: (0, "")})
    for initial, must_go, truncated in rows:
        new = {}
        for s, (cost, audit) in labels.items():
            moves = [(s, 4, "D")]
            if not must_go:
                moves.append((C.ADDED[s], 3 + 3 * truncated, "R"))
                if initial in C.AFTER[s]:
                    moves.append((C.AFTER[s][initial], 3 * truncated, "K"))
            for to, step, e in moves:
                new[to] = min(new.get(to, (10**9, "")), (cost + step, audit + e))
        labels = inserted(new)
    return min(labels[s] for s in C.ACCEPTING if s in labels)


def test_long_conversations_and_pieces_compose():
    rng = random.Random(5)
    for n in (0, 1, 7, 40, 120):
        rows = lattice(random_rows(rng, n))
        want = forward_only(rows)
        assert C.cheapest(rows) == want
        for size in (1, 3, 50):
            parts = [rows[i:i + size] for i in range(0, n, size)] or [[]]
            pieces = [{"n_turns": 0, "n_rows": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                       "transfers": [dict(zip(("before", "after", "cost", "audit"), t))
                                     for t in C.transfers(p, k == 0, k == len(parts) - 1)]} for k, p in enumerate(parts)]
            total, chosen = C._compose(pieces)
            assert (total["cost"], total["audit"]) == want
            assert "".join(a for _, a in chosen) == want[1]


def brute(table):
    """The whole query by plain loops, over the rows as given."""
    def white(c):
        return c in " \t\n\x0b\x0c\r"

    groups = {}
    for conv, turn, role, text in table:
        rows = groups.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        if code != 0:
            rows += [(turn, role, text)] * (2 if code == 3 else 1)
    out = set()
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in rows:
            solid = [c for c in text if not white(c)]
            faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        full = [(r, t, f in (1, 2), f == 3) for (_, r, t), f in zip(rows, faults)]
        cost, audit = forward_only(lattice(full))
        text = "\n".join(f"{r}:{t}" for r, t in repaired(full, audit))
        out.add((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs),
                 cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    texts = ["Fine.", "Fine?", "cut off", " ", "", None, "two\nlines!", "日本.", "ends. \t"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < .4 else f"text {c} {t}.")
            for c in [*range(30), None] for t in range(rng.randrange(1, 12))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", f"long {t}.") for t in range(90)]
    rows += [(101, None, "user", "x."), (101, None, "user", "x."), (101, 5, "assistant", "y"), (101, 5, "assistant", "y"), (101, 5, None, None)]
    rows += [(102, t, "user", "a" * 50_000 + ".") for t in range(3)] + [(7, 3, "user", "again."), (7, 3, "user", "again.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("piece_rows", [256, 4])
def test_repair_equals_plain_loops(spark, table, piece_rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(table, SCHEMA).repartition(6)
    for c in ("piece", "at", "fault", "_key", "copy"):
        df = df.withColumn(c, F.lit("clash"))
    got = [tuple(r) for r in C.repair(df, piece_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(table)


def test_conversation_that_loses_all_rows(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = C.repair(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).collect() == []

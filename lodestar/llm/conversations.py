"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A conversation's rows are edited until their roles' initials read ``(s?(ua)+)?``. A
lattice node is (rows read, state): the states are the start, after ``s``, after
``u`` and after ``a``. Keep costs nothing, Rerole and Insert 3, Delete 4; a truncated
row that stays adds 3; blank and duplicate rows must be deleted. A forward heap
starts at the first node, a reverse heap at the accepting ones; the search ends
when no path through both frontiers can be as cheap as the best meeting, so that all
equal-cost crossings are known, and the least audit (the edits' initials) among them wins.

Rows are numbered in (conv_id, turn, role, text) order over the whole table, so
duplicates come from a grouped minimum and not from a scan of the conversation. A
conversation is searched in pieces of ``PIECE_ROWS`` rows. One that has a single
piece is done in its task. Others yield, per piece and pair of states, the cheapest and
least audit; these compose piece by piece, exactly: a piece's audit ends in a row's
edit (inserts belong to the next piece), so of two different audits of a piece
none is the beginning of the other. The repaired text is then hashed as
a stream. A task holds one piece of rows, and the audits of one conversation.

Defined results: null role and text are one space, also in the hash. Null turns come
first and are left out of the gaps; null conv_ids are one conversation. Rows with
equal turns are ordered by role and text. An empty role has no place in the wanted
order, so its row is given a role or deleted. A conversation without rows
after damage has zero counts, an empty audit and the hash of the empty text. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import pinned
from lodestar.operators.rowid import global_row_id

# --- fixed values -----------------------------------------------------------
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})   # state -> initial -> state
ADDED = (USER, USER, ASSISTANT, USER)                                            # the role a state asks for
ROLE = {USER: "user", ASSISTANT: "assistant"}
# ---------------------------------------------------------------------------
PIECE_ROWS = 256

Row = tuple[str, bool, bool]          # initial of the role, must go, truncated
Node = tuple[int, int]                # rows read, state
INF = float("inf")


class Lattice:
    """Edges of the edit lattice of one piece; ``tail`` allows inserts behind the last row."""

    def __init__(self, rows: Sequence[Row], tail: bool):
        self.rows, self.last = rows, len(rows) if tail else len(rows) - 1

    def _row_edges(self, i: int, state: int) -> Iterator[tuple[int, int, str]]:
        initial, must_go, truncated = self.rows[i]
        yield state, DELETE, "D"
        if not must_go:
            more = TRUNCATED if truncated else 0
            if initial in AFTER[state]:
                yield AFTER[state][initial], KEEP + more, "K"
            yield ADDED[state], REROLE + more, "R"

    def out(self, node: Node) -> Iterator[tuple[Node, int, str]]:
        i, state = node
        if i < len(self.rows):
            for to, cost, edit in self._row_edges(i, state):
                yield (i + 1, to), cost, edit
        if i <= self.last:
            yield (i, ADDED[state]), INSERT, "I"

    def into(self, node: Node) -> Iterator[tuple[Node, int, str]]:
        i, state = node
        for before in range(4):
            if i > 0:
                for to, cost, edit in self._row_edges(i - 1, before):
                    if to == state:
                        yield (i - 1, before), cost, edit
            if i <= self.last and ADDED[before] == state:
                yield (i, before), INSERT, "I"


class Frontier:
    """Dijkstra from one end: cheapest cost and, among equal costs, the least audit of each node.

    Edges of cost 0 lead on by a row; equal costs leave the heap in row
    order, so a node's audit is final when it does.
    """

    def __init__(self, starts: Iterable[Node], forward: bool):
        self.sign = 1 if forward else -1
        self.best: dict[Node, tuple[int, str]] = {}
        self.done: set[Node] = set()
        self.heap: list[tuple[int, int, int]] = []
        for node in starts:
            self.offer(node, 0, "")

    def offer(self, node: Node, cost: int, audit: str) -> None:
        old = self.best.get(node)
        if old is None or (cost, audit) < old:
            self.best[node] = cost, audit
            if old is None or cost < old[0]:
                heapq.heappush(self.heap, (cost, self.sign * node[0], node[1]))

    def top(self) -> float:
        while self.heap and ((i := self.sign * self.heap[0][1]), self.heap[0][2]) in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else INF

    def settle(self) -> Node:
        _, i, state = heapq.heappop(self.heap)
        node = self.sign * i, state
        self.done.add(node)
        return node


def cheapest(rows: Sequence[Row], start: int = START, ends: Sequence[int] = ACCEPTING, tail: bool = True) -> tuple[int, str] | None:
    """Cost and least audit from a state before the rows to one of ``ends`` behind them; None if there is no way."""
    lattice = Lattice(rows, tail)
    goals = [(len(rows), e) for e in ends]
    front, back = Frontier([(0, start)], True), Frontier(goals, False)
    best = INF
    while front.top() + back.top() <= best and (front.top() < INF or back.top() < INF):
        forward = front.top() <= back.top()
        mine, other = (front, back) if forward else (back, front)
        node = mine.settle()
        cost, audit = mine.best[node]
        if node in other.best:
            best = min(best, cost + other.best[node][0])
        for to, step, edit in (lattice.out(node) if forward else lattice.into(node)):
            mine.offer(to, cost + step, audit + edit if forward else edit + audit)
            if to in other.best:
                best = min(best, cost + step + other.best[to][0])
    if best == INF:
        return None
    ahead, behind = front.done | {(0, start)}, back.done | set(goals)       # the ends' own labels are final
    found = [front.best[n][1] + back.best[n][1] for n in ahead & behind if front.best[n][0] + back.best[n][0] == best]
    for node in ahead:                          # crossings by an edge between the two settled sides
        cost, audit = front.best[node]
        found += [audit + edit + back.best[to][1] for to, step, edit in lattice.out(node)
                  if to in behind and cost + step + back.best[to][0] == best]
    return int(best), min(found)


def transfers(rows: Sequence[Row], first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """``(state before, state after, cost, audit)`` of a piece; all ends count as one behind the last piece."""
    out = []
    for start in ((START,) if first else range(4)):
        for ends in ((ACCEPTING,) if last else tuple((e,) for e in range(4))):
            if found := cheapest(rows, start, ends, last):
                out.append((start, ends[0], *found))
    return out


def edited(roles: Iterable[str], texts: Iterable[str], audit: str, state: int = START) -> Iterator[str]:
    """The repaired rows as ``role:text``."""
    rows = zip(roles, texts)
    for edit in audit:
        if edit == "I":
            state = ADDED[state]
            yield ROLE[state] + ":"
            continue
        role, text = next(rows)
        if edit == "R":
            state = ADDED[state]
            yield f"{ROLE[state]}:{text}"
        elif edit == "K":
            state = AFTER[state][role[:1]]
            yield f"{role}:{text}"


class LineHash:
    """sha256 of lines joined by line breaks, as a stream."""

    def __init__(self) -> None:
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, lines: Iterable[str]) -> LineHash:
        for line in lines:
            self.sha.update(("\n" + line if self.begun else line).encode())
            self.begun = True
        return self

    def hex(self) -> str:
        return self.sha.hexdigest()


# --- damage -----------------------------------------------------------------

def _keyed(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text, dropped`` after the damage that the rows' keys choose."""
    code = F.crc32(F.concat(_keyed(F.col("conv_id")), F.lit(":"), _keyed(F.col("turn"))).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = df.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"),
                     F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                     (code == 0).alias("dropped"), F.when(code == 3, 2).otherwise(1).alias("_copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


# --- repair -----------------------------------------------------------------

_STATS = ("lowest", "highest", "n_turns", "blank", "duplicate", "truncated", "illegal")
_PIECE = T.StructType([
    T.StructField("piece", T.LongType()), T.StructField("n_pieces", T.LongType()),
    T.StructField("n_rows", T.LongType()), T.StructField("first_turn", T.LongType()), T.StructField("first_role", T.StringType()),
    T.StructField("last_role", T.StringType()), *[T.StructField(c, T.LongType()) for c in _STATS],
    T.StructField("transfers", T.ArrayType(T.StructType([
        T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()),
        T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))),
    T.StructField("sha256", T.StringType())])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
    for batch in batches:
        names, columns = batch.schema.names, [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        for values in zip(*columns):
            yield dict(zip(names, values))


def _arrow(rows: list[dict[str, Any]], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=list(names))


def _emit(rows: Iterator[dict[str, Any]], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == 512:
            yield _arrow(held, arrow.names, arrow.types)
            held = []
    if held:
        yield _arrow(held, arrow.names, arrow.types)


def _piece(conv: Any, rows: list[dict[str, Any]]) -> dict[str, Any]:
    """Counts, transfers and, if it is the only one, the hash of a piece."""
    head = rows[0]
    kept = [r for r in rows if not r["dropped"]]
    turns = [r["turn"] for r in kept if r["turn"] is not None]
    initials = [r["role"][:1] for r in kept]
    lattice = [(i, r["fault"] in (1, 2), r["fault"] == 3) for i, r in zip(initials, kept)]
    first, last = head["piece"] == 0, head["piece"] == head["n_pieces"] - 1
    found = transfers(lattice, first, last)
    sha = None
    if first and last:
        sha = LineHash().add(edited((r["role"] for r in kept), (r["text"] for r in kept), found[0][3])).hex()
    return {"conv_id": conv, "piece": head["piece"], "n_pieces": head["n_pieces"], "n_rows": len(kept),
            "first_turn": turns[0] if turns else None, "first_role": initials[0] if kept else None,
            "last_role": initials[-1] if kept else None, "lowest": min(turns, default=None), "highest": max(turns, default=None),
            "n_turns": len(set(turns)), "blank": sum(r["fault"] == 1 for r in kept), "duplicate": sum(r["fault"] == 2 for r in kept),
            "truncated": sum(r["fault"] == 3 for r in kept),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "transfers": [dict(zip(("before", "after", "cost", "audit"), t)) for t in found], "sha256": sha}


def _compose(pieces: Iterable[dict[str, Any]]) -> tuple[dict[str, Any], list[tuple[int, str]]]:
    """Totals of a conversation, and the state before and the audit of each piece."""
    total = {"lowest": None, "highest": None, "n_turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    role = None
    labels = {START: (0, "")}
    steps: list[dict[int, tuple[int, str]]] = []              # per piece: state after -> state before, audit
    for p in pieces:
        for c in ("n_turns", "blank", "duplicate", "truncated", "illegal"):
            total[c] += p[c]
        if p["n_turns"]:
            total["n_turns"] -= p["first_turn"] == total["highest"]      # pieces come in turn order
            total["lowest"] = p["lowest"] if total["lowest"] is None else total["lowest"]
            total["highest"] = p["highest"]
        if p["n_rows"]:
            total["illegal"] += role is not None and role + p["first_role"] not in LEGAL
            role = p["last_role"]
        after: dict[int, tuple[int, str]] = {}
        step: dict[int, tuple[int, str]] = {}
        for t in p["transfers"]:
            if t["before"] in labels:
                label = labels[t["before"]][0] + t["cost"], labels[t["before"]][1] + t["audit"]
                if t["after"] not in after or label < after[t["after"]]:
                    after[t["after"]], step[t["after"]] = label, (t["before"], t["audit"])
        labels = after
        steps.append(step)
    state = min(labels, key=labels.get)
    total["cost"], total["audit"] = labels[state]
    chosen = []
    for step in reversed(steps):
        state, audit = step[state]
        chosen.append((state, audit))
    return total, chosen[::-1]


def _ordered(df: DataFrame, piece_rows: int) -> DataFrame:
    """Rows in order (``at``) with fault (1 blank, 2 duplicate, 3 truncated, else 0), piece and number of pieces."""
    rows = global_row_id(damaged(df).withColumn("_u", F.monotonically_increasing_id()),
                         ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy", "_u"], "at").drop("copy", "_u")
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("_key", key)
    again = (rows.filter("not dropped").groupBy(F.col("_key").alias("_same")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .filter("_n > 1").drop("_n"))
    sizes = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("at").alias("_from"), F.count(F.lit(1)).alias("_size"))
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(ends == "", 1).when(F.col("at") > F.col("_first"), 2).when(~ends.isin(".", "!", "?"), 3).otherwise(0))
    return (rows.join(again, F.col("_key") == F.col("_same"), "left")
            .join(sizes, F.col("conv_id").eqNullSafe(F.col("_conv")))
            .select("conv_id", "turn", "role", "text", "dropped", "at", fault.alias("fault"),
                    F.floor((F.col("at") - F.col("_from")) / piece_rows).cast("long").alias("piece"),
                    F.ceil(F.col("_size") / piece_rows).cast("long").alias("n_pieces")))


def repair(df: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of ``df`` (``conv_id, turn, role, text``) after damage.

    Columns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    conv = T.StructField("conv_id", df.schema["conv_id"].dataType)
    rows = pinned(_ordered(df, piece_rows))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_stream(batches), key=lambda r: (r["conv_id"], r["piece"]))
        return _emit((_piece(c, list(g)) for (c, _), g in groups), T.StructType([conv, *_PIECE]))

    pieces = pinned(rows.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at")
                    .mapInArrow(search, T.StructType([conv, *_PIECE])))
    whole = pieces.filter("n_pieces = 1").select(
        "conv_id", *_STATS, F.col("transfers")[0]["cost"].alias("cost"), F.col("transfers")[0]["audit"].alias("audit"), "sha256")

    totals = T.StructType([conv, T.StructField("piece", T.LongType()), T.StructField("before", T.IntegerType()),
                           T.StructField("edits", T.StringType()), *[T.StructField(c, T.LongType()) for c in (*_STATS, "cost")],
                           T.StructField("audit", T.StringType())])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for c, group in groupby(_stream(batches), key=lambda r: r["conv_id"]):
            total, chosen = _compose(group)
            blank = dict.fromkeys(total)
            yield {"conv_id": c, "piece": None, "before": None, "edits": None, **total}
            yield from ({"conv_id": c, "piece": k, "before": s, "edits": a, **blank} for k, (s, a) in enumerate(chosen))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(composed(batches), totals)

    several = pinned(pieces.filter("n_pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
                     .mapInArrow(compose, totals))
    chosen = several.filter("piece is not null").select(F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), "before", "edits")
    hashes = T.StructType([conv, T.StructField("sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, Any]]:
        for c, group in groupby(_stream(batches), key=lambda r: r["conv_id"]):
            sha = LineHash()
            for _, piece in groupby(group, key=lambda r: r["piece"]):
                part = list(piece)
                kept = [r for r in part if not r["dropped"]]
                sha.add(edited((r["role"] for r in kept), (r["text"] for r in kept), part[0]["edits"], part[0]["before"]))
            yield {"conv_id": c, "sha256": sha.hex()}

    def stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(hashed(batches), hashes)

    texts = (rows.filter("n_pieces > 1")
             .join(chosen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))
             .select("conv_id", "piece", "at", "role", "text", "dropped", "before", "edits")
             .repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(stream_hash, hashes))
    long = (several.filter("piece is null")
            .join(texts.select(F.col("conv_id").alias("_conv"), "sha256"), F.col("conv_id").eqNullSafe(F.col("_conv")))
            .select(*whole.columns))
    gaps = F.coalesce(F.col("highest") - F.col("lowest") + 1 - F.col("n_turns"), F.lit(0))
    return whole.unionByName(long).select(
        "conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha256").alias("repaired_sha256"))

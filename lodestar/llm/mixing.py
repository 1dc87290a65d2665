"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). A flow routes each pattern's words to the quotas of its sources; a second
and a third pass over a pattern cost more than the first (convex repetition
costs), so repetition starts only where a quota can't be met otherwise. Costs
stand on the arcs out of the flow's origin only, and an augmenting path never
takes flow back from such an arc; filling the passes in order of cost, each to
a maximum flow, therefore gives the minimum cost.

The driver holds one number per (pattern, source); it never sees documents.
Within a pattern documents are ordered by a seeded hash of their doc_id, and
each part of the flow becomes a cut-off in that order: one histogram of hash
buckets per pattern, then a running sum inside the buckets a cut falls in. The
cut-offs then decide each document where it lies, without a shuffle of texts.

Defined results: a null text has size 0; null sources are a source of their own,
last in order; documents of size 0 take 0 words. Rows with the same doc_id (or
without one) in one pattern share a place in the order and so a decision. Reruns
agree, since only the seed and the doc_ids decide. Extra columns pass through
``mix`` whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import pinned, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_PASSES = 3
SEED = 20
KEY_BITS = 60
BUCKET_BITS = 12


def target_sizes(sizes: Sequence[int], weights: Sequence[float], passes: int = MAX_PASSES) -> list[float]:
    """Shares of the total by weight, none above ``passes`` times its own size.

    What a capped source can't take is shared again by weight among the others,
    until none is above: sources are capped in order of size per weight.
    """
    left, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: passes * sizes[i] / weights[i])
    for at, i in enumerate(order):
        cap = float(passes * sizes[i])
        if cap * weight > left * weights[i]:
            for j in order[at:]:
                out[j] = left * weights[j] / weight
            return out
        out[i] = cap
        left -= cap
        weight -= weights[i]
    return out


def min_cost_flow(capacity: dict[str, int], members: dict[str, Sequence[str]], quota: dict[str, int],
                  passes: int = MAX_PASSES) -> dict[tuple[str, str], int]:
    """Words routed from each pattern to each of its sources.

    Pass ``k`` over a pattern is an arc of the pattern's size at cost ``k``;
    passes are opened in order of cost and shortest augmenting paths (breadth
    first, over pattern-source arcs and their reverses) are filled until none is left.
    """
    flow = {(p, s): 0 for p in capacity for s in members[p]}
    of_source: dict[str, list[str]] = {}
    for p, s in flow:
        of_source.setdefault(s, []).append(p)
    room = {s: int(q) for s, q in quota.items()}
    for _ in range(passes):
        supply = dict(capacity)
        for start in sorted(capacity):
            while supply[start] > 0:
                came: dict[tuple[str, str], tuple[str, str] | None] = {("p", start): None}
                queue, goal = deque([("p", start)]), None
                while queue and goal is None:
                    kind, x = queue.popleft()
                    steps = ([("s", s) for s in members[x]] if kind == "p"
                             else [("p", p) for p in of_source[x] if flow[p, x] > 0])
                    for step in steps:
                        if step not in came:
                            came[step] = (kind, x)
                            if step[0] == "s" and room.get(step[1], 0) > 0:
                                goal = step
                                break
                            queue.append(step)
                if goal is None:
                    break
                path = [goal]
                while (prev := came[path[-1]]) is not None:
                    path.append(prev)
                path.reverse()
                amount = min([supply[start], room[goal[1]],
                              *[flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1], b[1]] += amount
                    else:
                        flow[b[1], a[1]] -= amount
                supply[start] -= amount
                room[goal[1]] -= amount
    return flow


def order_key(id_col: Column, seed: int = SEED) -> Column:
    """60 bits of a seeded hash of the id: the order of documents inside a pattern."""
    hexed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(hexed, 1, KEY_BITS // 4), 16, 10).cast("long")


def _pattern(members: Column) -> Column:
    """Canonical text of a set of sources (null sources stay null inside the set)."""
    return F.to_json(F.struct(F.sort_array(F.array_distinct(members)).alias("s")), {"ignoreNullFields": "false"})


def _code_point_order(name: str | None):
    return (name is None, name or "")


def plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = MAX_PASSES) -> DataFrame:
    """Decide from ``rows(members array<string>, size, key)`` what each pattern gives each source.

    Returns ``(pattern, source, source_size, target, lo_full, lo_cut, hi_full,
    hi_cut)``: a document takes ``hi_full - lo_full + (key <= hi_cut) - (key <= lo_cut)`` copies.
    """
    spark = rows.sparkSession
    shift = KEY_BITS - BUCKET_BITS
    keyed = rows.select(_pattern(F.col("members")).alias("pattern"), "members", "size", "key",
                        F.shiftright("key", shift).alias("bucket"))
    histogram = pinned(keyed.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"),
                                                              F.first("members").alias("members")))
    patterns = histogram.groupBy("pattern").agg(F.sum("words").alias("words"), F.first("members").alias("members")).collect()
    names = {p["pattern"]: sorted(set(p["members"]), key=_code_point_order) for p in patterns}
    words = {p["pattern"]: int(p["words"]) for p in patterns}
    sources = sorted({s for ss in names.values() for s in ss}, key=_code_point_order)
    size_of = {s: sum(words[p] for p in words if s in names[p]) for s in sources}
    share = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total = sum(words.values())
    targets = target_sizes_of(sources, size_of, share, total, passes)
    tag = {s: str(i) for i, s in enumerate(sources)}
    flow = min_cost_flow(words, {p: [tag[s] for s in names[p]] for p in names},
                         {tag[s]: round(targets[s]) for s in sources}, passes)
    parts, cuts = [], set()
    for p in sorted(words):
        end = 0
        for s in names[p]:
            start, end = end, end + flow[p, tag[s]]
            parts.append((p, s, start, end))
            cuts |= {(p, start), (p, end)}
    inner = sorted({(p, c % words[p]) for p, c in cuts if words[p]})
    cut_rows = spark.createDataFrame(inner, "pattern string, at long")
    cutoff = {(r["pattern"], r["at"]): r["cut"] for r in _cut_offs(keyed, histogram, cut_rows, shift).collect()}
    at = lambda p, c: (c // words[p], cutoff.get((p, c % words[p]), -1)) if words[p] else (0, -1)
    out = [(p, s, size_of[s], targets[s], *at(p, a), *at(p, b)) for p, s, a, b in parts]
    return spark.createDataFrame(out, "pattern string, source string, source_size long, target double, "
                                      "lo_full long, lo_cut long, hi_full long, hi_cut long")


def target_sizes_of(sources, size_of, share, total, passes) -> dict:
    """``target_sizes`` by source; where sources overlap the total is that of the documents."""
    sizes = [size_of[s] for s in sources]
    if sum(sizes) == total:
        return dict(zip(sources, target_sizes(sizes, [share[s] for s in sources], passes)))
    scale = total / sum(sizes) if sum(sizes) else 0.0
    scaled = target_sizes([x * scale for x in sizes], [share[s] for s in sources], passes)
    return dict(zip(sources, scaled))


def _cut_offs(keyed: DataFrame, histogram: DataFrame, cuts: DataFrame, shift: int) -> DataFrame:
    """``(pattern, at, cut)``: the last key whose words lie mostly before ``at`` in the hash order."""
    by_bucket = (F.expr("sum(words) over (partition by pattern order by bucket)") - F.col("words")).alias("before")
    starts = histogram.select("pattern", "bucket", "words", by_bucket)      # at most 2**BUCKET_BITS rows a pattern
    hit = (starts.join(cuts, "pattern").filter("before <= at and at < before + words")
           .select("pattern", "bucket", "at", "before"))
    inside = (keyed.join(hit, ["pattern", "bucket"]).groupBy("pattern", "bucket", "at", "before", "key")
              .agg(F.sum("size").alias("words")))
    run = (F.expr("sum(words) over (partition by pattern, bucket, at order by key)") - F.col("words")).alias("done")
    placed = inside.select("pattern", "bucket", "at", "before", "key", "words", run)
    taken = F.when(F.col("before") + F.col("done") + F.col("words") / 2 < F.col("at"), F.col("key"))
    none = F.shiftleft(F.col("bucket"), shift) - 1
    return placed.groupBy("pattern", "bucket", "at").agg(F.max(taken).alias("m")).select(
        "pattern", "at", F.coalesce("m", none).alias("cut"))


def members_of(df: DataFrame, source_col: str) -> Column:
    """A source column as a set of sources: arrays as they are, scalars as sets of one; a null or empty array is the null source."""
    col = F.col(f"`{source_col}`")
    if not isinstance(df.schema[source_col].dataType, T.ArrayType):
        return F.array(col.cast("string"))
    every = col.cast("array<string>")
    return F.when(F.coalesce(F.size(every), F.lit(0)) > 0, every).otherwise(F.array(F.lit(None).cast("string")))


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: Sequence[float] = WEIGHTS, passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """One row per document and source of it: id, size, source, source_size, target, copies."""
    rows = pinned(df.select(F.col(id_col).alias("id"), members_of(df, source_col).alias("members"),
                            word_count(F.col(text_col)).alias("size"), order_key(F.col(id_col), seed).alias("key")))
    chosen = plan(rows, weights, passes)
    # The plan has one row per (pattern, source); the driver has just held all of it.
    return (rows.withColumn("pattern", _pattern(F.col("members"))).join(F.broadcast(chosen), "pattern")
            .select(F.col("id").alias(id_col), "size", "source", "source_size", "target", _copies().alias("copies")))


def _copies() -> Column:
    return (F.col("hi_full") - F.col("lo_full") + (F.col("key") <= F.col("hi_cut")).cast("long")
            - (F.col("key") <= F.col("lo_cut")).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, passes: int = MAX_PASSES, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row as often as it is taken; the input's columns."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
                       members_of(df, source_col).alias("members"), order_key(F.col(id_col), seed).alias("key"),
                       word_count(F.col(text_col)).alias("size"))
    chosen = plan(pinned(packed.select("members", "size", "key")), weights, passes)
    taken = (packed.drop("size").withColumn("pattern", _pattern(F.col("members"))).drop("members")
             .join(F.broadcast(chosen.select("pattern", "lo_full", "lo_cut", "hi_full", "hi_cut")), "pattern")
             .withColumn("_copies", _copies().cast("int")).filter("_copies > 0"))
    return taken.select("_all", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_n")).select("_all.*")

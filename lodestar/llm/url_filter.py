"""URL filter: host word segmentation by unigram Viterbi, then naive Bayes; explicit rules go first.

Host labels such as ``freebets`` are split by a unigram model: the Viterbi path
maximises the sum of log word probabilities, unknown stretches pay by length.
The unigram counts come from all words of the pages' visible text and all
delimited words of their URLs, and every one of them is in the vocabulary. A
multinomial naive Bayes model is counted over all pages that a rule decides (the
rule is the label), with add-one smoothing over every token.

Both models are Spark tables. Distinct names (host labels and path words) are
cut and scored once each, not once a page: their substrings are joined with the
words, their parts with the tokens. The ``max_words`` most frequent words and the
scores of the ``max_tokens`` most frequent names are broadcast besides, which
spares those joins their hot keys and changes no result.

Rules: a rule fits its host and all subdomains if the url's path starts with the
rule's path; of several the one with the longest text wins, and its verdict
stands. Otherwise ``block`` if the model's probability of it exceeds one half.

Defined results: a null url, or one without ``://``, has empty host and path; a
url without tokens, or without rule-decided pages to learn from, is allowed.
A tie of verdicts goes to ``allow``. Repeated rows count and are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import flag_members, key_set, pinned, small_batches

# --- fixed values: (host, path, verdict) --------------------------------------
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# ---------------------------------------------------------------------------
MAX_WORDS = 50_000        # words that are broadcast; the rest is joined
MAX_TOKENS = 50_000       # names whose scores are broadcast; the rest is joined
_PIECES = 65_536          # rows of a batch of substrings
_DELIMITED = re.compile(r"[^\W_]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def names_of(host: str, path: str) -> list[str]:
    """Delimited words of host and path after their place, ``h:`` or ``p:``; numbers of the path are all one word."""
    return [*["h:" + x for x in _DELIMITED.findall(host)],
            *["p:" + ("0" if x.isdigit() else x) for x in _DELIMITED.findall(path.lower())]]


class Table(Mapping):
    """``rows(key, value)`` that stay in Spark; only reading it as a mapping collects them."""

    def __init__(self, rows: DataFrame, bound: int):
        self.rows, self.bound = rows, bound

    @cached_property
    def _all(self) -> dict:
        return dict(self.rows.collect())

    def __getitem__(self, key):
        return self._all[key]

    def __iter__(self):
        return iter(self._all)

    def __len__(self):
        return len(self._all)


class Segmenter:
    """Unigram Viterbi over ``counts``, of a corpus of ``total`` words. Knows nothing of Spark."""

    def __init__(self, counts: Mapping[str, int], total: int | None = None, longest: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: self.cost_of(n) for w, n in counts.items()}
        self.longest = longest or max(map(len, counts), default=1)
        self.unknown = math.log(self.total) + 1.0      # the first character of an unknown stretch costs this
        self.per_char = math.log(26.0)            # and each of its characters this besides

    def cost_of(self, n: int) -> float:
        return -math.log(n / self.total)

    def split(self, name: str, more: Mapping[str, int] | None = None) -> list[str]:
        """The cheapest cut of ``name`` into known words, those of ``more`` too, and unknown stretches (whole, not by character)."""
        others = {w: self.cost_of(k) for w, k in (more or {}).items()}
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        stretch = [math.inf] * (n + 1)      # cheapest end inside an unknown stretch that began at ``begin``
        begin = [0] * (n + 1)
        for j in range(1, n + 1):
            fresh, grown = best[j - 1] + self.unknown + self.per_char, stretch[j - 1] + self.per_char
            if fresh <= grown:
                stretch[j], begin[j] = fresh, j - 1
            else:
                stretch[j], begin[j] = grown, begin[j - 1]
            best[j], back[j] = stretch[j], begin[j]
            for i in range(max(0, j - self.longest), j):
                c = self.cost.get(name[i:j], others.get(name[i:j]) if others else None)
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        out = []
        while n:
            out.append(name[back[n]:n])
            n = back[n]
        return out[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Segmented words of host and path; a word's place (host or path) is part of the token, numbers are all one word."""
        return [name[:2] + w for name in names_of(host, path) for w in self.split(name[2:])]


def _most_frequent(counted: DataFrame, bound: int) -> list:
    """Rows of a pinned ``counted(..., n)`` with the largest ``n``, at most ``bound``: rows of equal count go
    in or stay out together, so none is preferred. The driver first sees one row a distinct count."""
    room, floor = bound, 0
    for r in sorted(counted.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["n"]):
        room -= r["k"]
        if room < 0:
            floor = r["n"]
            break
    return counted.filter(F.col("n") > floor).collect()


def unigrams(pages: DataFrame, max_words: int = MAX_WORDS) -> Table:
    """Counts ``(w, n)`` of all words of the pages' visible text and of their delimited url words."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>", " ")
    named = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[^:]*://", "")
    # Undelimited host labels are what is to be segmented; only labels of several words teach words.
    url_words = F.regexp_extract_all(F.lower(named), F.lit(r"(?<=-)\p{L}+|\p{L}+(?=-)|(?<=[/=&?])\p{L}+"), 0)
    words = pages.select(F.explode(F.concat(F.regexp_extract_all(F.lower(visible), F.lit(r"\p{L}+"), 0), url_words)).alias("w"))
    words = words.filter(F.length("w") > 0)
    return Table(pinned(words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))), max_words)


def _named(df: DataFrame) -> DataFrame:
    """``df(..., host, path)`` with the ``names`` of both."""
    at = [df.columns.index(c) for c in ("host", "path")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [names_of(h, p) for h, p in zip(*[batch.column(k).to_pylist() for k in at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.list_(pa.string()))], names=[*batch.schema.names, "names"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("names", T.ArrayType(T.StringType()))]))


def _parts(keyed: DataFrame, words: Table) -> DataFrame:
    """The rows of a pinned ``keyed(key, ...)``, keys as of ``names_of``, with the ``tokens`` of each key."""
    spark = keyed.sparkSession
    frequent = spark.sparkContext.broadcast({r["w"]: r["n"] for r in _most_frequent(words.rows, words.bound)})
    total, longest = words.rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.length("w")), F.lit(1))).head()
    names = keyed.select(F.expr("substring(key, 3)").alias("name")).distinct()
    names = pinned(names.withColumn("at", F.monotonically_increasing_id()))    # long names are not repeated by substring

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every substring that may be a word and is not broadcast."""
        known, whole, out = frequent.value, [], []
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in range(len(name)):
                    more = [w for j in range(i + 1, min(i + longest, len(name)) + 1) if (w := name[i:j]) not in known]
                    whole.extend([at] * len(more))
                    out.extend(more)
                    if len(out) >= _PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int64()), pa.array(out, pa.string())], names=["at", "w"])
                        whole, out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(whole, pa.int64()), pa.array(out, pa.string())], names=["at", "w"])

    # The bitmap lets no word go, and keeps most other substrings out of the shuffle; the join is exact.
    found = flag_members(names.mapInArrow(pieces, "at long, w string"), key_set(words.rows, ["w"]), "near")
    hits = (found.filter("near").select("at", "w").join(words.rows, "w").groupBy("at")
            .agg(F.collect_set(F.struct("w", "n")).alias("hits")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(frequent.value, total, longest)
        for batch in batches:
            cuts = [cutter.split(name, {h["w"]: h["n"] for h in hits or ()})
                    for name, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, pa.list_(pa.string()))], names=["name", "parts"])

    cut = names.join(hits, "at", "left").select("name", "hits").mapInArrow(run, "name string, parts array<string>")
    placed = F.transform("parts", lambda w: F.concat(F.substring("key", 1, 2), w))
    return (keyed.withColumn("name", F.expr("substring(key, 3)")).join(cut, "name")
            .select(*[F.col(c) for c in keyed.columns], placed.alias("tokens")))


def fit(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_words: int = MAX_WORDS,
        max_tokens: int = MAX_TOKENS) -> tuple[Table, Table, float | None]:
    """``(unigram counts, log odds of block by token, prior log odds)``; the prior is null if nothing is labelled."""
    spark = pages.sparkSession
    small_batches(spark, 4096)
    words = unigrams(pages, max_words)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    labelled = pages.select(host.alias("host"), path.alias("path"), rule_of(host, path, rules)[1].alias("y")).filter("y is not null")
    block = (F.col("y") == "block").cast("long")
    docs = labelled.agg(F.sum(block).alias("block"), F.sum(1 - block).alias("allow")).head()
    if docs["block"] is None:
        return words, Table(spark.createDataFrame([], "t string, odds double"), max_tokens), None
    prior = math.log((docs["block"] + 1) / (docs["allow"] + 1))
    keyed = pinned(_named(labelled).select(F.explode("names").alias("key"), block.alias("b"))
                   .groupBy("key").agg(F.sum("b").alias("block"), F.sum(1 - F.col("b")).alias("allow")))
    counted = pinned(_parts(keyed, words).select(F.explode("tokens").alias("t"), "block", "allow")
                     .groupBy("t").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    n = counted.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0)), F.count(F.lit(1))).head()
    odds = F.log((F.col("block") + 1) / F.lit(n[0] + n[2])) - F.log((F.col("allow") + 1) / F.lit(n[1] + n[2]))
    return words, Table(counted.select("t", odds.alias("odds")), max_tokens), prior


def _scores(keyed: DataFrame, words: Table, odds: Table) -> DataFrame:
    """``(key, n, score)`` of the rows of ``keyed(key, n)``: the summed log odds of each key's tokens, in their order."""
    tokens = _parts(keyed, words).select("key", "n", F.posexplode("tokens").alias("pos", "t"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("odds", F.lit(0.0)).alias("odds"))))
    return (tokens.join(odds.rows, "t", "left").groupBy("key", "n").agg(ordered.alias("o"))
            .select("key", "n", F.aggregate("o", F.lit(0.0), lambda s, x: s + x["odds"]).alias("score")))


def judge(pages: DataFrame, model: tuple[Table, Table, float | None], id_col: str = "page_id",
          rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``id_col, host, path, rule, verdict, p_block`` of every page; only pages with a name that is not broadcast are shuffled."""
    spark = pages.sparkSession
    small_batches(spark, 4096)
    words, odds, prior = model
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    score = F.lit(0.0)
    if prior is None:
        scored = parsed
    else:
        named = pinned(_named(parsed))      # pins the row numbers, too
        keyed = pinned(named.select(F.explode("names").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        scores = pinned(_scores(keyed, words, odds))
        frequent = spark.sparkContext.broadcast({r["key"]: r["score"] for r in _most_frequent(scores, odds.bound)})
        known = pa.list_(pa.struct([("pos", pa.int32()), ("score", pa.float64())]))
        rare = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = frequent.value
            for batch in batches:
                names = batch.column(4).to_pylist()
                near = [[(k, have[x]) for k, x in enumerate(row) if x in have] for row in names]
                far = [[(k, x) for k, x in enumerate(row) if x not in have] for row in names]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(near, known), pa.array(far, rare)],
                                                 names=[*batch.schema.names[:4], "known", "rare"])

        pairs = "array<struct<pos:int,score:double>>"
        lookup = T.StructType.fromDDL(f"known {pairs}, rare array<struct<pos:int,key:string>>")
        looked = named.mapInArrow(run, T.StructType([*parsed.schema.fields, *lookup.fields]))
        late = looked.filter(F.size("rare") > 0).drop("rare")
        found = (looked.select("row", F.explode("rare").alias("r")).select("row", "r.pos", "r.key").join(scores, "key")
                 .groupBy("row").agg(F.collect_list(F.struct("pos", "score")).alias("found")))
        scored = (looked.filter(F.size("rare") == 0).drop("rare").withColumn("found", F.array().cast(pairs))
                  .unionByName(late.join(found, "row")))
        every = F.sort_array(F.concat("known", "found"))
        score = F.when(F.size(every) == 0, 0.0).otherwise(F.aggregate(every, F.lit(prior), lambda s, x: s + x["score"]))
    bounded = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), score))
    scored = scored.select(F.col("id").alias(id_col), "host", "path", (1.0 / (1.0 + F.exp(-bounded))).alias("p_block"))
    return scored.select(id_col, "host", "path", text.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")

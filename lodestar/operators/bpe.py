"""Subword tokenizer as Spark jobs.

* Word counting is one shuffle with map-side combine, so a word holding a
  third of all occurrences costs one partial count per task.
* BPE training works on the distinct-word table, never on occurrences. Each
  round cuts all words at the pairs that cannot win in it, learns a merge sequence from
  the distinct parts, computes its exact per-step pair-count deltas over the distributed
  word table, keeps the prefix that provably equals the sequential choice (``_verify``), adds
  the deltas of the kept steps to the pair counts and rewrites only the words that changed.
* Encoding runs in Arrow batches: the JVM pre-tokenizes, each Python worker
  keeps a word -> ids cache, and padding/truncation is a JVM expression.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodestar import config
from lodestar.functions.text import pretokens
from lodestar.session import checkpoint_root, ship_package


# ------------------------------------------------------------- counting ----
def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """A10: ``(word, cnt)`` over all pre-tokens of ``text_col``."""
    return (texts.select(F.explode(pretokens(text_col)).alias("word"))
                 .groupBy("word").agg(F.count(F.lit(1)).alias("cnt")))


def _chars(col: str) -> Column:
    return F.expr(f"transform(sequence(1, char_length({col})), i -> substring({col}, i, 1))")


def alphabet(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Distinct characters of the words (``symbol``), code point order."""
    return words.select(F.explode(_chars(word_col)).alias("symbol")).distinct()


def bpe_pair_counts(words: DataFrame, word_col: str = "word", cnt_col: str = "cnt") -> DataFrame:
    """B2: weighted counts of adjacent character pairs of the word table.

    Overlapping positions count (``aaaa`` has three ``aa``).
    """
    pairs = F.expr(f"transform(sequence(1, char_length({word_col}) - 1), "
                   f"i -> named_struct('left', substring({word_col}, i, 1), "
                   f"'right', substring({word_col}, i + 1, 1)))")
    return (words.where(F.char_length(word_col) >= 2)
                 .select(F.inline(pairs), F.col(cnt_col))
                 .groupBy("left", "right").agg(F.sum(cnt_col).cast("bigint").alias("cnt")))


def pad_truncate(ids: Column | str, length: int, pad_id: int = config.PAD_ID) -> Column:
    """Cut to ``length`` on the right, right-pad with ``pad_id``."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(F.concat(c, F.array_repeat(F.lit(pad_id), F.lit(length))), 1, length)


# --------------------------------------------------------------- model ----
@dataclass
class BpeModel:
    """Vocabulary (token -> id) and ordered merges ``(left_id, right_id, new_id)``."""
    vocab: dict[str, int]
    merges: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def id_to_token(self) -> list[str]:
        out = [""] * (max(self.vocab.values()) + 1 if self.vocab else 0)
        for t, i in self.vocab.items():
            out[i] = t
        return out

    def fingerprint(self) -> str:
        h = hashlib.sha1(json.dumps([sorted(self.vocab.items()), self.merges]).encode())
        return h.hexdigest()

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(((t, i) for t, i in self.vocab.items()), key=lambda x: x[1]),
                                     "token string, id int")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r, a, b, n) for r, (a, b, n) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, id int")

    @classmethod
    def from_frames(cls, vocab: DataFrame, merges: DataFrame) -> BpeModel:
        """Model-sized state only: at most ``vocab_size`` rows each."""
        v = {r["token"]: int(r["id"]) for r in vocab.collect()}
        m = sorted((int(r["rank"]), int(r["left"]), int(r["right"]), int(r["id"])) for r in merges.collect())
        return cls(v, [(a, b, n) for _, a, b, n in m])


# -------------------------------------------------------------- training ----
def _merge_symbols(syms: Sequence[int], a: int, b: int, new: int) -> list[int]:
    out, i, n = [], 0, len(syms)
    while i < n:
        if i + 1 < n and syms[i] == a and syms[i + 1] == b:
            out.append(new)
            i += 2
        else:
            out.append(syms[i])
            i += 1
    return out


def _pairs(syms: Sequence[int]) -> Counter:
    return Counter(zip(syms, syms[1:]))


_WORD_SCHEMA = "word string, cnt long, syms array<int>"
_PART_WORDS = 20_000          # words of a partition


def _in_order(syms: list[int], rank: dict[tuple[int, int], int], merges: list[tuple[int, int, int]]):
    """Apply the merges that concern one word, in their order; yields ``(step, before, after)``."""
    cur, last = list(syms), -1
    while True:
        j = min((r for p in zip(cur, cur[1:]) if (r := rank.get(p, -1)) > last), default=None)
        if j is None:
            return
        new = _merge_symbols(cur, *merges[j])
        yield j, cur, new
        cur, last = new, j


def _ranks(merges: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Step of each pair; of a pair that occurs twice the first one counts."""
    return {(a, b): j for j, (a, b, _) in reversed(list(enumerate(merges)))}


def _apply_round(merges: list[tuple[int, int, int]]):
    """Re-segment words with the accepted merges."""
    rank = _ranks(merges)

    def run(batches):
        for pdf in batches:
            out = []
            for syms in pdf["syms"]:
                cur = list(syms)
                for _, _, cur in _in_order(cur, rank, merges):
                    pass
                out.append(cur)
            yield pd.DataFrame({"word": pdf["word"], "cnt": pdf["cnt"], "syms": out})
    return run


def _initial_symbols(char_ids: dict[str, int]):
    def run(batches):
        for pdf in batches:
            syms = [[char_ids[ch] for ch in w] for w in pdf["word"]]
            yield pd.DataFrame({"word": pdf["word"], "cnt": pdf["cnt"].astype("int64"), "syms": syms})
    return run


def _pairs_of_words(batches):
    for pdf in batches:
        acc: Counter = Counter()
        for cnt, syms in zip(pdf["cnt"], pdf["syms"]):
            for p, k in _pairs(list(syms)).items():
                acc[p] += k * int(cnt)
        yield pd.DataFrame({"l": [p[0] for p in acc], "r": [p[1] for p in acc],
                            "c": np.array(list(acc.values()), dtype=np.int64)})


_PART_SCHEMA = "syms array<int>, cnt long"
_READS = 8                    # the driver reads a table in so many jobs, one after the other
_PART_SYMBOLS = 16            # symbols of a part that the driver learns from, on average at most


def _parts(pairs: list[tuple[int, int]]):
    """Words cut at every pair that is not listed, with the counts of equal parts added.

    Counts of existing pairs only fall, and a pair that comes to span a cut counts at most what
    the cut pair did: merges of listed pairs alone have the same counts over the parts as over the words.
    """
    listed = set(pairs)

    def run(batches):
        for pdf in batches:
            acc: Counter = Counter()
            for cnt, syms in zip(pdf["cnt"], pdf["syms"]):
                syms, start = tuple(syms), 0
                for i, p in enumerate(zip(syms, syms[1:]), 1):
                    if p not in listed:
                        if i - start > 1:
                            acc[syms[start:i]] += int(cnt)
                        start = i
                if len(syms) - start > 1:
                    acc[syms[start:]] += int(cnt)
            if acc:
                yield pd.DataFrame({"syms": [list(k) for k in acc], "cnt": np.array(list(acc.values()), dtype=np.int64)})
    return run


_DELTA_SCHEMA = "j int, l int, r int, c long"


def _speculate(rows, vocab: dict[str, int], id_to_token: list[str], steps: int, min_count: int,
               top_rows=()) -> list[tuple[int, int, int]]:
    """The next merges: the exact loop on the parts of the words (on copies),
    started from the exact global counts of the top pairs. ``rows`` is read once."""
    words, counts = [], array("q")
    for syms, c in rows:
        words.append(array("i", syms))
        counts.append(c)
    base = {(l, r): c for l, r, c in top_rows}
    return _merge_loop(words, counts, dict(vocab), list(id_to_token), 1 << 30, min_count, steps, base)


def _step_deltas(seq: list[tuple[int, int, int]]):
    """Per word, apply the speculated merges in order and emit each step's pair-count changes."""
    rank = _ranks(seq)

    def run(batches):
        for pdf in batches:
            acc: Counter = Counter()
            for cnt, syms in zip(pdf["cnt"], pdf["syms"]):
                c = int(cnt)
                for j, cur, new in _in_order(syms, rank, seq):
                    for p in zip(cur, cur[1:]):
                        acc[(j, p[0], p[1])] -= c
                    for p in zip(new, new[1:]):
                        acc[(j, p[0], p[1])] += c
            nz = [(k, v) for k, v in acc.items() if v]
            yield pd.DataFrame({"j": [k[0] for k, _ in nz], "l": [k[1] for k, _ in nz],
                                "r": [k[2] for k, _ in nz], "c": np.array([v for _, v in nz], dtype=np.int64)})
    return run


def _by_step(rows) -> dict[int, np.ndarray]:
    """Rows ``(j, l, r, c)``, read once, as each step's array of ``(l, r, c)``."""
    flat = array("q")
    for row in rows:
        flat.extend(row)
    table = np.frombuffer(flat, dtype=np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    steps, starts = np.unique(table[:, 0], return_index=True)
    return dict(zip(steps.tolist(), np.split(table[:, 1:], starts[1:])))


def _verify(seq, top_rows, threshold, deltas, vocab, id_to_token, vocab_size, min_count):
    """Accept the speculated merges while each equals the exact argmax.

    ``top_rows`` are the exact top pair counts at the start of the round and
    every other pair counted at most ``threshold``; existing pairs only lose
    counts during the round, and pairs holding a symbol created this round
    are known exactly from the step deltas. A step is decided only when the
    best known count is strictly above ``threshold``; the round ends before the
    first mismatch, whose deltas are not known. The first step is always the argmax.
    """
    known = {(l, r): c for l, r, c in top_rows}
    heap = [(-c, p) for p, c in known.items()]      # counts that changed since are skipped when met
    heapq.heapify(heap)
    created: set[int] = set()
    accepted = []
    for j in range(len(seq)):
        if len(vocab) >= vocab_size:
            break
        while heap and known[heap[0][1]] != -heap[0][0]:
            heapq.heappop(heap)
        if not heap:
            break
        negc, best = heap[0]
        if negc >= 0 or -negc < min_count or (j > 0 and -negc <= threshold):
            break
        a, b = best
        if (a, b) != seq[j][:2]:
            break
        token = id_to_token[a] + id_to_token[b]
        reused = token in vocab
        new_id = vocab[token] if reused else len(id_to_token)
        if not reused:
            vocab[token] = new_id
            id_to_token.append(token)
        accepted.append((a, b, new_id))
        if reused:              # its symbol is not new: pairs that hold it are not all known
            break
        for l, r, d in deltas[j].tolist() if j in deltas else ():
            if (l, r) in known or l in created or r in created or l == new_id or r == new_id:
                known[(l, r)] = known.get((l, r), 0) + d
                heapq.heappush(heap, (-known[(l, r)], (l, r)))
        created.add(new_id)
    return accepted


def _merge_loop(words: list[Sequence[int]], counts: Sequence[int], vocab: dict[str, int], id_to_token: list[str],
                vocab_size: int, min_count: int, max_merges: int | None = None,
                base_counts: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int, int]]:
    """The sequential merge loop over segmented words (mutates ``words``, ``vocab``, ``id_to_token``).

    ``base_counts`` overrides the starting count of the pairs it holds (exact
    global counts when ``words`` is only a subset).
    """
    pair_counts: Counter = Counter()
    where: dict[tuple[int, int], array] = {}        # word numbers, some more than once
    for wi, syms in enumerate(words):
        for p, k in _pairs(syms).items():
            pair_counts[p] += k * counts[wi]
            where.setdefault(p, array("i")).append(wi)
    if base_counts:
        pair_counts.update({p: c - pair_counts.get(p, 0) for p, c in base_counts.items()})
    heap = [(-c, p[0], p[1]) for p, c in pair_counts.items() if c > 0]
    heapq.heapify(heap)
    merges: list[tuple[int, int, int]] = []
    while heap and len(vocab) < vocab_size and (max_merges is None or len(merges) < max_merges):
        negc, a, b = heapq.heappop(heap)
        cur = pair_counts.get((a, b), 0)
        if cur != -negc:
            if cur > 0:
                heapq.heappush(heap, (-cur, a, b))
            continue
        if cur < min_count:
            break
        token = id_to_token[a] + id_to_token[b]
        new_id = vocab.get(token)
        if new_id is None:
            new_id = len(id_to_token)
            vocab[token] = new_id
            id_to_token.append(token)
        merges.append((a, b, new_id))
        # ``where`` is a superset index: words that no longer hold (a, b) are skipped
        fresh: set[tuple[int, int]] = set()
        for wi in where.pop((a, b), ()):
            old = words[wi]
            new = _merge_symbols(old, a, b, new_id)
            if len(new) == len(old):
                continue
            c = counts[wi]
            for p in zip(old, old[1:]):
                pair_counts[p] -= c
            for p in zip(new, new[1:]):
                pair_counts[p] += c
                if p[0] == new_id or p[1] == new_id:
                    fresh.add(p)
                    where.setdefault(p, array("i")).append(wi)
            words[wi] = array("i", new)
        pair_counts.pop((a, b), None)
        # only pairs holding the new symbol grew; lowered counts are re-checked when popped
        for p in fresh:
            c = pair_counts.get(p, 0)
            if c > 0:
                heapq.heappush(heap, (-c, p[0], p[1]))
    return merges


def _needed(moved: DataFrame, top: DataFrame, n_old: int, bar: int) -> DataFrame:
    """The step deltas that can decide a step: of the listed pairs, and of pairs with a new symbol that can reach ``bar``."""
    fresh = moved.where((F.col("l") >= n_old) | (F.col("r") >= n_old))
    reach = (fresh.where("c > 0").groupBy("l", "r").agg(F.sum("c").alias("_up")).where(F.col("_up") >= bar).drop("_up"))
    return fresh.join(reach, ["l", "r"], "left_semi").unionByName(moved.join(F.broadcast(top), ["l", "r"], "left_semi")).distinct()


def _holds(symbols: set[int]) -> Column:
    """The word holds one of the symbols."""
    return F.expr(f"arrays_overlap(syms, array({', '.join(map(str, sorted(symbols)))}))")


def bpe_train(words: DataFrame, vocab_size: int = config.VOCAB_SIZE,
              min_count: int = config.VOCAB_MIN_COUNT,
              specials: tuple[str, ...] = config.SPECIAL_TOKENS,
              top_pairs: int = 32_768, speculate_words: int = 100_000, speculate_steps: int = 8192,
              word_col: str = "word", cnt_col: str = "cnt", progress=None) -> BpeModel:
    """Learn BPE merges from a distinct-word table ``(word, cnt)``.

    Ids: specials first, then every character by code point, then merges in
    order. Each step merges the pair with the largest weighted count (ties:
    smaller left id, then smaller right id) and stops when the best count is
    below ``min_count`` or the vocabulary reaches ``vocab_size``.

    The state is two checkpointed tables: the segmented words and the pair counts. The words are
    counted into pairs once. A round reads the exact top pair counts and cuts all words at the other
    pairs (``_parts``); it takes fewer top pairs until the distinct parts number ``speculate_words`` at
    most. From all parts it learns a merge sequence, computes the exact per-step pair-count deltas of that
    sequence over the words that hold its pairs, and accepts the merges while each is the true argmax
    (``_verify``): all that count more than the last top pair, unless one makes a token that exists.
    The deltas of the accepted steps bring the pair counts up to date; only
    words that changed are written anew. The driver holds at most ``top_pairs`` pairs,
    ``speculate_words`` parts and the deltas of pairs whose count can still win, a number that
    the least winning count bounds.
    """
    spark = words.sparkSession
    checkpoint_root(spark)
    ship_package(spark)
    w0 = words.select(F.col(word_col).alias("word"), F.col(cnt_col).cast("long").alias("cnt"))
    w0 = w0.checkpoint(eager=True)          # the corpus is read and counted once
    chars = sorted(r["symbol"] for r in alphabet(w0).collect())   # model-sized: the alphabet
    vocab: dict[str, int] = {}
    for t in [*specials, *chars]:
        if t not in vocab:
            vocab[t] = len(vocab)
    id_to_token = [t for t, _ in sorted(vocab.items(), key=lambda x: x[1])]
    char_ids = {ch: vocab[ch] for ch in chars}
    n_parts = max(spark.sparkContext.defaultParallelism, w0.count() // _PART_WORDS)
    cur = w0.repartition(n_parts, "word").mapInPandas(_initial_symbols(char_ids), _WORD_SCHEMA).checkpoint(eager=True)
    pairs = (cur.mapInPandas(_pairs_of_words, "l int, r int, c long")
                .groupBy("l", "r").agg(F.sum("c").alias("c")).checkpoint(eager=True))
    merges: list[tuple[int, int, int]] = []
    rounds = 0
    while len(vocab) < vocab_size:
        best = pairs.orderBy(F.col("c").desc(), "l", "r").limit(top_pairs)
        top_rows = list(best.toPandas()[["l", "r", "c"]].itertuples(index=False, name=None))
        if not top_rows or top_rows[0][2] < min_count:
            break
        every = len(top_rows) < top_pairs
        while True:
            threshold = 0 if every else top_rows[-1][2]     # every other pair counts at most this
            bar = max(min_count, threshold)
            parts = (cur.mapInPandas(_parts([(l, r) for l, r, c in top_rows if c >= bar]), _PART_SCHEMA)
                        .groupBy("syms").agg(F.sum("cnt").alias("cnt")).checkpoint(eager=True))
            n, symbols = parts.agg(F.count(F.lit(1)), F.sum(F.size("syms"))).first()
            if len(top_rows) == 1 or n <= speculate_words and symbols <= _PART_SYMBOLS * speculate_words:
                break
            top_rows, every = top_rows[:(len(top_rows) + 3) // 4], False
        limit = min(speculate_steps, vocab_size - len(vocab))
        seq = _speculate(parts.select("syms", "cnt").coalesce(_READS).toLocalIterator(), vocab, id_to_token, limit, bar, top_rows)
        n_old = len(id_to_token)
        moved = (cur.where(_holds({a for a, _, _ in seq if a < n_old})).mapInPandas(_step_deltas(seq), _DELTA_SCHEMA)
                    .groupBy("j", "l", "r").agg(F.sum("c").alias("c")).where("c != 0").checkpoint(eager=True))
        top = spark.createDataFrame(pd.DataFrame(top_rows, columns=["l", "r", "c"])[["l", "r"]], "l int, r int")
        needed = _needed(moved, top, n_old, bar)
        deltas = _by_step(needed.select("j", "l", "r", "c").coalesce(_READS).toLocalIterator())
        accepted = _verify(seq, top_rows, threshold, deltas, vocab, id_to_token, vocab_size, min_count)
        merges.extend(accepted)
        rounds += 1
        if progress is not None:
            progress(rounds, len(merges), len(vocab))
        if len(vocab) >= vocab_size:
            break
        pairs = (pairs.unionByName(moved.where(F.col("j") < len(accepted)).drop("j"))
                      .groupBy("l", "r").agg(F.sum("c").alias("c")).where("c > 0").checkpoint(eager=True))
        holds = _holds({a for a, _, _ in accepted})
        changed = cur.where(holds).mapInPandas(_apply_round(accepted), _WORD_SCHEMA)   # only these words can change
        cur = cur.where(~holds).unionByName(changed).coalesce(n_parts).checkpoint(eager=True)
    return BpeModel(vocab, merges)


# -------------------------------------------------------------- encoding ----
class _WordEncoder:
    """Applies merges by rank to one word; unknown characters give one UNK each."""

    def __init__(self, model: BpeModel, unk_id: int = config.UNK_ID):
        self.char_ids = {t: i for t, i in model.vocab.items() if len(t) == 1}
        self.ranks = {(a, b): (rank, n) for rank, (a, b, n) in enumerate(model.merges)}
        self.unk = unk_id
        self.cache: dict[str, list[int]] = {}

    def encode_word(self, word: str) -> list[int]:
        hit = self.cache.get(word)
        if hit is not None:
            return hit
        syms = [self.char_ids.get(ch, self.unk) for ch in word]
        ranks = self.ranks
        while len(syms) > 1:
            best, best_pos = None, -1
            for i in range(len(syms) - 1):
                r = ranks.get((syms[i], syms[i + 1]))
                if r is not None and (best is None or r[0] < best[0]):
                    best, best_pos = r, i
            if best is None:
                break
            syms = syms[:best_pos] + [best[1]] + syms[best_pos + 2:]
        if len(self.cache) < 1_000_000:
            self.cache[word] = syms
        return syms


_ENCODERS: dict[str, _WordEncoder] = {}


def bpe_encode(df: DataFrame, text_col: str, model: BpeModel, length: int | None,
               out_col: str = "ids") -> DataFrame:
    """Text -> ids (merges by rank), then C12 pad/truncate to ``length``.

    The whole text is pre-tokenized and encoded; truncation to ``length`` is
    the padding step of the tokenizer, applied afterwards.
    """
    spark = df.sparkSession
    ship_package(spark)
    key = model.fingerprint()
    bc = spark.sparkContext.broadcast(model)     # model-sized: <= vocab_size merges

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        enc = _ENCODERS.get(key)
        if enc is None:
            _ENCODERS.clear()        # one model a worker
            enc = _ENCODERS[key] = _WordEncoder(bc.value)
        out = []
        for ws in words:
            ids: list[int] = []
            if ws is not None:
                for w in ws:
                    ids.extend(enc.encode_word(w))
            out.append(ids)
        return pd.Series(out)

    ids = encode(pretokens(text_col))
    return df.withColumn(out_col, pad_truncate(ids, length) if length else ids)


def tokenize_fields(df: DataFrame, model: BpeModel, code_len: int = config.CODE_LENGTH,
                    query_len: int = config.QUERY_LENGTH) -> DataFrame:
    """``code`` to ``code_ids`` (L=200) and ``query`` to ``query_ids`` (L=30)."""
    return bpe_encode(bpe_encode(df, "code", model, code_len, "code_ids"), "query", model, query_len, "query_ids")


def tokenize_with(df: DataFrame, text_col: str, fn: Callable[[str], list[int]] | Callable[[], Callable],
                  length: int, out_col: str = "ids", factory: bool = False) -> DataFrame:
    """A user-supplied tokenizer ``str -> list[int]`` in Arrow batches.

    With ``factory=True`` ``fn`` is called once per Python worker to build the
    tokenizer (for heavy objects that should not be pickled per task).
    """
    ship_package(df.sparkSession)
    holder: dict = {}

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        tok = holder.get("tok")
        if tok is None:
            tok = holder["tok"] = fn() if factory else fn
        return pd.Series([list(map(int, tok(t))) if t is not None else [] for t in texts])

    return df.withColumn(out_col, pad_truncate(encode(F.col(text_col)), length))


# ---------------------------------------------------------- word vocab ----
def word_vocab(counts: DataFrame, size: int, n_special: int = len(config.SPECIAL_TOKENS)) -> DataFrame:
    """Word-level vocabulary: the ``size - n_special`` most frequent words.

    ``(word, id)`` with ids from ``n_special`` by count desc, then word. The
    result is bounded by ``size`` rows (a top-k report over the counts).
    """
    top = counts.orderBy(F.col("cnt").desc(), F.col("word")).limit(size - n_special).collect()
    rows = [(r["word"], i + n_special) for i, r in enumerate(top)]
    return counts.sparkSession.createDataFrame(rows, "word string, id int")


def word_encode(df: DataFrame, text_col: str, vocab: DataFrame, length: int,
                out_col: str = "ids", unk_id: int = config.UNK_ID) -> DataFrame:
    """Word-level tokenizer (a B6 tokenizer): pre-tokens looked up in ``vocab``."""
    ship_package(df.sparkSession)
    table = {r["word"]: int(r["id"]) for r in vocab.collect()}   # bounded by the vocab size
    bc = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(words: pd.Series) -> pd.Series:
        t = bc.value
        return pd.Series([[t.get(w, unk_id) for w in ws] if ws is not None else [] for ws in words])

    return df.withColumn(out_col, pad_truncate(encode(pretokens(text_col)), length))

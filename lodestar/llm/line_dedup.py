"""Substring dedup by hashing the clauses of unwrapped paragraphs.

Line breaks inside a paragraph are blanks, so wrapping does not matter. A unit is a
clause: words up to one that ends in ``. , ; : ! ?``, to a blank line, or to the end. A clause
of more than ``LONG`` words, as in unpunctuated text, is cut again behind every word
whose md5 is divisible by ``CUT``: such cuts follow the content, not the position. Units
are normalised (A-Z lower-cased, ASCII white space collapsed) and hashed to 128 bits together
with the next unit, since short clauses alone repeat by chance. Digests are grouped over the whole corpus, the
earliest occurrence of each stays, and neighbouring repeated units form a run. Runs of at
least ``min_words`` words are spans to remove, in code points of the original text.
Occurrences rank by doc_id (null last), then by place in the text.

The first pass sends one 64-bit number per pair of units, combined before the shuffle; the
numbers that occur twice travel on as a bitmap. The second pass sends only pairs that the
bitmap holds, and groups them by their whole digest. A digest that a third of the corpus holds sends one row a task to
the group-by; its occurrences then meet the survivor in a join that adaptive execution can split. Runs form per
document in sorted streams, so a task holds one run at a time.

Defined results: null and empty texts have no units; a text of one unit is hashed alone. Rows that repeat a doc_id
are separate documents in an arbitrary but fixed order, so only one of them
keeps a shared passage; ``remove_repeats`` cuts each row by its own spans. Extra columns are ignored
by ``repeated_spans`` and pass through ``remove_repeats`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import collect_bitmap, pinned, small_batches

MIN_WORDS = 30
LONG = 24
CUT = 8
CLOSING = ".,;:!?"
_BLANKS = " \t\n\x0b\x0c\r"
_END = re.compile(rf"[{CLOSING}](?=[\x20\x09-\x0D]|\Z)|\n[\x20\x09-\x0D]*\n|\Z")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Unit = tuple[int, int, int, bytes]        # start, end, words, normalised text


def units(text: str | None) -> list[Unit]:
    """The clauses of a text."""
    out: list[Unit] = []
    text, at = text or "", 0
    for m in _END.finditer(text):
        clause = text[at:m.end()]
        words = clause.encode().split()                   # splits bytes at ASCII white space only
        if len(words) > LONG:
            out += _pieces(clause, at, words)
        elif words:
            start = at + len(clause) - len(clause.lstrip(_BLANKS))
            out.append((start, start + len(clause.strip(_BLANKS)), len(words), b" ".join(words).lower()))
        at = m.end()
    return out


def _pieces(clause: str, at: int, words: list[bytes]) -> Iterator[Unit]:
    """A long clause cut behind every word whose hash says so."""
    places = [m.span() for m in _WORD.finditer(clause)]
    first = 0
    for k, word in enumerate(words, 1):
        if k == len(words) or hashlib.md5(word.lower()).digest()[0] % CUT == 0:
            yield at + places[first][0], at + places[k - 1][1], k - first, b" ".join(words[first:k]).lower()
            first = k


def pair_digests(found: list[Unit]) -> list[bytes]:
    """Digest of each unit and its successor; a text's only unit goes alone."""
    texts = [u[3] for u in found]
    joined = [a + b"\n" + b for a, b in zip(texts, texts[1:])] if len(texts) > 1 else texts
    return [hashlib.blake2b(t, digest_size=16).digest() for t in joined]


def _upper(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def _keyed(df: DataFrame, id_col: str, text_col: str, row: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text"))


def _repeated_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs of units whose digest occurs again: ``id, row, at, start, middle, end, n_first, n_second, digest``.

    ``start`` and ``end`` are the pair's, ``middle`` is the first unit's end, the numbers count the units' words.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [d for t in batch.column(0).to_pylist() for d in pair_digests(units(t))]
            found, counts = np.unique(_upper(digests), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["key", "n"])

    again = (keyed.select("text").mapInArrow(send, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"))
    shared = keyed.sparkSession.sparkContext.broadcast(collect_bitmap(pinned(again.select("key")), "key"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                found = units(text)
                digests = pair_digests(found)
                for u in np.flatnonzero(shared.value.holds(_upper(digests))).tolist() if digests else ():
                    one, two = found[u], found[min(u + 1, len(found) - 1)]
                    at.append(k)
                    out.append((u, one[0], two[1], one[2], two[2] if len(found) > 1 else 0, digests[u]))
            columns = list(zip(*out)) if out else [()] * 6
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, pa.int64()) for c in columns[:5]],
                 pa.array(columns[5], pa.binary())], names=["id", "row", *_PAIR, "digest"])

    schema = T.StructType([T.StructField("id", keyed.schema["id"].dataType), T.StructField("row", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in _PAIR], T.StructField("digest", T.BinaryType())])
    return pinned(keyed.mapInArrow(collect, schema))          # pins the row numbers, too


_PAIR = ("at", "start", "end", "n_first", "n_second")


def _spans(keyed: DataFrame, min_words: int) -> DataFrame:
    """``id, row, start, end, n_words, n_units, keep_id, keep_start`` of each run that is long enough."""
    found = _repeated_pairs(keyed)
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row").alias("r"),
                    F.col("at").alias("a"), F.col("start").alias("s"))
    first = (found.groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(F.concat("digest", F.lit(b"")).alias("_digest"), "best"))
    later = (found.join(first, F.col("digest") == F.col("_digest"))
             .filter((F.col("row") != F.col("best.r")) | (F.col("at") != F.col("best.a")))
             .select("id", "row", *_PAIR, F.col("best.i").alias("keep_id"), F.col("best.s").alias("keep_start")))
    id_type = keyed.schema["id"].dataType
    numbers = ("start", "end", "n_words", "n_units", "keep_start")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("keep_id", id_type),
                           *[T.StructField(c, T.LongType()) for c in numbers]])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(b.num_columns))))
        numbered = ((r[1], r[2] - k, r) for k, r in enumerate(rows))          # neighbours of a row keep the difference
        out = []
        for _, group in groupby(numbered, key=lambda r: r[:2]):
            head = last = None
            words = n_units = 0
            for *_, last in group:
                head = head or last
                words += last[5]
                n_units += 1
            words, n_units = words + last[6], n_units + (last[6] > 0)
            if words >= min_words:
                out.append((head[0], head[1], head[7], head[3], last[4], words, n_units, head[8]))
        columns = list(zip(*out)) if out else [()] * 8
        types = [arrow, pa.int64(), arrow, *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "row", "keep_id", *numbers])

    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(id_type)
    return later.repartition("row").sortWithinPartitions("row", "at").mapInArrow(runs, schema)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per span to remove: ``id_col, start, end, n_words, n_units, keep_id, keep_start``.

    ``keep_id`` and ``keep_start`` say where the run's first pair of units stands that stays.
    """
    numbered = df.select(id_col, text_col, F.monotonically_increasing_id().alias("_row"))
    return _spans(_keyed(numbered, id_col, text_col, "_row"), min_words).select(
        F.col("id").alias(id_col), "start", "end", "n_words", "n_units", "keep_id", "keep_start")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a span takes the blanks behind it along, or those before it at the text's end."""
    out, at = [], 0
    for start, end in sorted(set(spans)):
        out.append(text[at:start])
        at = end + len(text[end:]) - len(text[end:].lstrip(" \t\n\x0b\x0c\r"))
    kept = "".join([*out, text[at:]])
    return kept.rstrip(" \t\n\x0b\x0c\r") if spans and at >= len(text) else kept


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their repeated passages removed; the input's columns. Each row is cut by its own spans."""
    every = pinned(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"), F.monotonically_increasing_id().alias("_row")))
    keyed = _keyed(every.select(F.col("_all")[id_col].alias("_id"), F.col("_all")[text_col].alias("_text"), "_row"), "_id", "_text", "_row")
    spans = (_spans(keyed, min_words).groupBy(F.col("row").alias("_of"))
             .agg(F.collect_list(F.struct("start", "end")).alias("_spans")))          # one document's spans
    joined = every.join(spans, F.col("_row") == F.col("_of"), "left").select("_all.*", "_spans")
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if t is None or not s else cut(t, [(x["start"], x["end"]) for x in s])
                     for t, s in zip(batch.column(schema.names.index(text_col)).to_pylist(), spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == text_col else batch.column(k) for k, c in enumerate(schema.names)],
                names=schema.names)

    return joined.mapInArrow(run, schema)

"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text (runs of non-letters become one
blank) are hashed to ``2 ** FEATURE_BITS`` features. Document frequencies are
counted over every learning document. The classifier is fitted by FTRL with
elastic-net penalties on a bounded sample (``per_language`` rows of each
language, chosen by a hash of doc_id, in one task); a fifth of the sample is
held back from it to find the temperature that calibrates its probabilities.
The model is ``features x languages`` numbers whatever the corpus, and is
broadcast; prediction is a narrow pass over whole texts.

Only ``text`` enters a prediction. Defined results: null texts and texts without
a letter give ``und`` with score 0; so does everything if no labelled document
was learned from. Rows without doc_id hash as the empty string. Repeated rows
count as often as they occur; ties of probability go to the first language in
code point order. Extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import linear
from lodestar.llm.common import pinned, small_batches

FEATURE_BITS = 16
PER_LANGUAGE = 2500       # bound of the fitting sample, rows of each language
HELD_BACK = 5             # one row in five of the sample calibrates
SEED = 6
_BLOCK = 1 << 20          # code points per block of a very long text
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_GRAMS = (1, 2, 3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2 are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string")), F.lit(0)) % 4 == 2


def ngram_counts(text: str, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of a whole text and their counts."""
    clean = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(1 << bits, np.int64)
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        for at in range(0, len(points), _BLOCK):
            for n in _GRAMS:
                block = points[at:at + _BLOCK + n - 1]
                if len(block) < n:
                    continue
                h = np.full(len(block) - n + 1, n, np.uint64)
                for k in range(n):
                    h = (h ^ block[k:len(block) - n + 1 + k]) * _MIX
                    h ^= h >> np.uint64(29)
                counts += np.bincount((h * _MIX) >> shift, minlength=1 << bits)
    index = np.flatnonzero(counts)
    return index, counts[index]


def tf_idf(index: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1.0 + np.log(counts)) * idf[index]
    norm = np.sqrt((value * value).sum())
    return value / norm if norm else value


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequency(texts: DataFrame, bits: int = FEATURE_BITS) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts. One bounded row set a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if has_letter(t):
                    df[ngram_counts(t, bits)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["f", "n"])

    rows = texts.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << bits, np.int64), 0
    for r in rows:
        if r["f"] < 0:
            total = int(r["n"])
        else:
            out[r["f"]] = r["n"]
    return out, total


def _pack(**arrays) -> bytes:
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    return buffer.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def _sampled(labelled: DataFrame, bound: int, seed: int) -> tuple[DataFrame, list[str]]:
    """About ``bound`` rows of each language (all, where there are fewer), by a hash of the id."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, bound / n))) for k, n in counts.items()], F.lit(0.0))
    return labelled.filter(unit < rate), sorted(counts)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, bits: int = FEATURE_BITS, seed: int = SEED,
        params: linear.Ftrl = linear.Ftrl(alpha=1.0, l1=0.02, l2=0.1, epochs=3)) -> bytes | None:
    """Learn from ``docs(doc_id, text, lang)``; null if no row has a language and a letter."""
    small_batches(docs.sparkSession)
    labelled = docs.filter("lang is not null")
    sample, languages = _sampled(labelled, per_language, seed)
    if not languages:
        return None
    df, total = document_frequency(labelled.select("text"), bits)
    if not total:
        return None
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    place = {k: i for i, k in enumerate(languages)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for i, t, k in zip(ids, texts, langs):
                if has_letter(t):
                    index, counts = ngram_counts(t, bits)
                    out.append((zlib.crc32(f"{seed}:{i}".encode()), place[k], index.astype(np.int32),
                                tf_idf(index, counts, idf)))
            out = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32())),
                 pa.array(out[3], pa.list_(pa.float64()))], names=["k", "y", "i", "v"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            k, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i, v = batch.column(2), batch.column(3)
            rows += [(k[j], y[j], i[j].values.to_numpy(), v[j].values.to_numpy()) for j in range(batch.num_rows)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), float(r[3].sum())))
        first: dict[int, int] = {}
        for at, r in enumerate(rows):
            first.setdefault(r[1], at)                  # one row of each language is always learned from
        held = [r[0] % HELD_BACK == 0 and first[r[1]] != at for at, r in enumerate(rows)]
        back, fitting = [r for r, h in zip(rows, held) if h], [r for r, h in zip(rows, held) if not h]
        w = linear.train([(i, v, y) for _, y, i, v in fitting], 1 << bits, len(languages), params)
        t = linear.temperature(np.array([linear.logits(w, i, v) for _, _, i, v in back]), np.array([r[1] for r in back], int))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(w=w, t=np.array(t), idf=idf, names=np.array(languages))])],
                                         names=["model"])

    sparse = pinned(sample.select("doc_id", "text", "lang").mapInArrow(features, "k long, y int, i array<int>, v array<double>"))
    # per_language bounds this one task's input
    model = sparse.repartition(1).mapInArrow(learn, "model binary").collect()
    return bytes(model[0]["model"]) if model else None


def predict(docs: DataFrame, model: bytes | None, text_col: str = "text", bits: int = FEATURE_BITS) -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the text alone (the text column is dropped)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _unpack(shared.value) if shared.value is not None else None
        names = [str(x) for x in m["names"]] if m else []
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(text_col).to_pylist():
                if m is None or not has_letter(t):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                index, counts = ngram_counts(t, bits)
                p = linear.softmax(linear.logits(m["w"], index, tf_idf(index, counts, m["idf"])) / float(m["t"]))
                best = int(p.argmax())
                langs.append(names[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())], names=[*others, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)

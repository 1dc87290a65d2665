"""Toxicity by a classifier chain over labelled categories.

The categories are predicted one after the other by sparse linear models on
hashed words and word stems; each model also sees the probabilities of the categories before
it. Those probabilities are out-of-fold while a later model is trained: the
sample is dealt into folds, and a fold is scored by a model that never saw it.
For prediction each category has one model, trained on all folds.

The models are fitted on a bounded sample of labelled rows (``max_rows``, by a
hash of doc_id); each fold's model is one group of that size at most. Scoring is
a narrow pass over whole texts with the broadcast weights (features x
categories, whatever the corpus).

Defined results: null and wordless texts are scored by the biases; a label that
is null is not learned from; without labels every probability is the category's
prior 0.5 and nothing is flagged. A repeated doc_id in the labels counts once
(its largest labels); repeated documents are all scored. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import linear
from lodestar.llm.common import pinned, small_batches

CATEGORIES = ("quality", "toxic")
MAX_ROWS = 20_000         # bound of the labelled sample
FOLDS = 5
FEATURE_BITS = 18
STEMS = (3, 5, 7)
SEED = 2
_WORDS = re.compile(r"[^\W\d_]+")


def word_features(text: str | None, bits: int = FEATURE_BITS) -> np.ndarray:
    """Distinct hashed features of the whole text, sorted: its lower-cased words and their stems
    (the first ``STEMS`` letters of a longer word)."""
    words = set(_WORDS.findall((text or "").lower()))
    parts = {w + " " for w in words}
    parts.update(w[:k] for w in words for k in STEMS if len(w) > k)
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(x.encode()) & mask for x in parts), np.int32))


def _with_chain(index: np.ndarray, before: Sequence[float], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature vector: the words, then the earlier categories' probabilities in their own slots."""
    slots = (1 << bits) + np.arange(len(before))
    return np.concatenate([index, slots]), np.concatenate([np.ones(len(index)), np.asarray(before, float)])


def _probability(w: np.ndarray, index: np.ndarray, value: np.ndarray) -> float:
    return float(linear.softmax(linear.logits(w, index, value))[1])


def _sample(docs: DataFrame, labels: DataFrame, categories: Sequence[str], max_rows: int, seed: int) -> DataFrame:
    """``(doc_id, text, y...)`` of at most about ``max_rows`` labelled documents."""
    labels = labels.filter("doc_id is not null").groupBy("doc_id").agg(*[F.max(c).alias(f"_y_{c}") for c in categories])
    n = labels.count()
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.filter(unit < min(1.0, max_rows / n)) if n else labels
    # max_rows bounds the broadcast side
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, max_rows: int = MAX_ROWS,
        folds: int = FOLDS, bits: int = FEATURE_BITS, seed: int = SEED,
        params: linear.Ftrl = linear.Ftrl(alpha=0.3, l1=8.0, l2=0.1, epochs=4)) -> list[np.ndarray | None]:
    """One weight matrix a category (null where no label was seen), in the chain's order."""
    small_batches(docs.sparkSession)
    width = (1 << bits) + len(categories)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [zlib.crc32(f"{seed}:{i}".encode()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([word_features(t, bits) for t in texts], pa.list_(pa.int32())),
                 pa.array(list(zip(*[batch.column(2 + k).to_pylist() for k in range(len(categories))])),
                          pa.list_(pa.float64()))], names=["k", "i", "y"])

    sample = _sample(docs, labels, categories, max_rows, seed).select(
        "doc_id", "text", *[F.col(f"_y_{c}").cast("double") for c in categories])
    rows = pinned(sample.mapInArrow(features, "k long, i array<int>, y array<double>")
                  .select("k", "i", "y", F.array().cast("array<double>").alias("before")))
    models: list[np.ndarray | None] = []
    for c in range(len(categories)):
        folds_now = [-1] if c == len(categories) - 1 else [-1, *range(folds)]
        dealt = rows.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds_now])))
        out = pinned(dealt.groupBy("fold").applyInPandas(_learner(c, folds, bits, width, params),
                                                         "k long, i array<int>, y array<double>, before array<double>"))
        final = out.filter("k = -1").collect()
        w = None
        if final and len(final[0]["i"]):
            w = np.zeros((width + 1, 2))
            w[np.array(final[0]["i"])] = np.array(final[0]["before"]).reshape(-1, 2)
        models.append(w)
        rows = out.filter("k >= 0")
    return models


def _lists(values: list) -> pd.Series:
    """A column of lists, also where there are none."""
    out = np.empty(len(values), object)
    for k, v in enumerate(values):
        out[k] = np.asarray(v)
    return pd.Series(out)


def _learner(c: int, folds: int, bits: int, width: int, params: linear.Ftrl):
    """The kernel that fits category ``c`` for one fold."""

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Train on the rows outside fold ``key`` and score those inside; fold -1 trains on all
        and returns the weights that are not zero as one row."""
        fold = int(key[0])
        part = part.sort_values(["k"], kind="stable")
        vectors = [(*_with_chain(i, b, bits), y[c]) for i, b, y in zip(part["i"], part["before"], part["y"])]
        inside = (part["k"] % folds == fold).to_numpy()
        known = [(i, v, int(y)) for (i, v, y), skip in zip(vectors, inside) if not skip and not np.isnan(y)]
        w = linear.train(known, width, 2, params) if known else None
        if fold < 0:
            at = np.flatnonzero(np.abs(w).sum(1)) if w is not None else np.empty(0, int)
            return pd.DataFrame({"k": [-1], "i": _lists([at.astype(np.int32)]), "y": _lists([[]]),
                                 "before": _lists([w[at].ravel() if w is not None else []])})
        p = [_probability(w, i, v) if w is not None else 0.5 for (i, v, _), s in zip(vectors, inside) if s]
        done = part[inside]
        return pd.DataFrame({"k": done["k"].to_numpy(), "i": _lists(list(done["i"])), "y": _lists(list(done["y"])),
                             "before": _lists([[*b, x] for b, x in zip(done["before"], p)])})

    return learn


def predict(docs: DataFrame, models: Sequence[np.ndarray | None], categories: Sequence[str] = CATEGORIES,
            bits: int = FEATURE_BITS) -> DataFrame:
    """``doc_id`` and ``p_<category>`` of every row, chained in order."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(list(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[list[float]] = []
            for t in batch.column(1).to_pylist():
                index, p = word_features(t, bits), []
                for w in shared.value:
                    p.append(0.5 if w is None else _probability(w, *_with_chain(index, p, bits)))
                scores.append(p)
            columns = [pa.array([s[k] for s in scores], pa.float64()) for k in range(len(categories))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                             names=["doc_id", *[f"p_{c}" for c in categories]])

    schema = docs.select("doc_id").schema
    for c in categories:
        schema = schema.add(f"p_{c}", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)

"""NBOW two-tower training as synchronous data-parallel steps.

One optimiser step takes ``batches_per_step`` mini-batches. Each mini-batch
passes a kernel (bounded by the batch size) that runs the
forward pass in training mode (batch-norm batch statistics, inverted dropout
from a seeded mask) and returns its loss, its batch-norm statistics and its
gradients, sparse in the embedding rows it touched. A step's mini-batches are dealt over
at most ``LANES`` tasks, each of which adds the gradients of its own in their order;
those sums (``LANES`` times the model at most) reach the driver, which
averages, clips by global norm, applies AdamW and re-broadcasts the weights.

The training rows are shuffled once per epoch into one partition per step and lane, and a step is one
job of one stage over its own partitions: every mini-batch passes its kernel once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import config
from lodestar.session import ship_package

LANES = 16                   # tasks of a step
PARAMS = ("embed", "fc_weight", "fc_bias", "bn_weight", "bn_bias")
EPS = config.BATCHNORM_EPS


# ------------------------------------------------------------ the math ----
def _forward(p: dict, ids: np.ndarray, mask: np.ndarray | None):
    n, length = ids.shape
    pooled = p["embed"][ids].sum(axis=1) / length
    h = pooled @ p["fc_weight"].T + p["fc_bias"][0]
    mu = h.mean(axis=0)
    var = h.var(axis=0)
    hhat = (h - mu) / np.sqrt(var + EPS)
    y = hhat * p["bn_weight"][0] + p["bn_bias"][0]
    z = np.tanh(y)
    zd = z * mask if mask is not None else z
    cache = dict(ids=ids, pooled=pooled, h=h, mu=mu, var=var, hhat=hhat, z=z, mask=mask)
    return zd, cache


def _unit(x: np.ndarray):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    norm = np.where(norm == 0, 1.0, norm)
    return x / norm, norm


def _backward(p: dict, cache: dict, dzd: np.ndarray, grads: dict) -> None:
    ids, n = cache["ids"], cache["ids"].shape[0]
    dz = dzd * cache["mask"] if cache["mask"] is not None else dzd
    dy = dz * (1.0 - cache["z"] ** 2)
    grads["bn_weight"][0] += (dy * cache["hhat"]).sum(axis=0)
    grads["bn_bias"][0] += dy.sum(axis=0)
    dhhat = dy * p["bn_weight"][0]
    inv = 1.0 / np.sqrt(cache["var"] + EPS)
    dh = inv / n * (n * dhhat - dhhat.sum(axis=0) - cache["hhat"] * (dhhat * cache["hhat"]).sum(axis=0))
    grads["fc_weight"] += dh.T @ cache["pooled"]
    grads["fc_bias"][0] += dh.sum(axis=0)
    dpooled = dh @ p["fc_weight"] / ids.shape[1]
    # embedding rows: scaled by the inverse token frequency in this call, pad row gets none
    flat = ids.reshape(-1)
    _, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(dpooled, ids.shape[1], axis=0) * (1.0 / counts)[at][:, None]
    dim = rows.shape[1]
    cells = (flat[:, None] * dim + np.arange(dim)).reshape(-1)          # one dimension: numpy adds these fast, in order
    np.add.at(grads["embed"].reshape(-1), cells, rows.reshape(-1))
    grads["embed"][0] = 0.0


def loss_and_grads(code_p: dict, query_p: dict, code_ids: np.ndarray, query_ids: np.ndarray,
                   dropout: float = 0.0, rng: np.random.Generator | None = None):
    """Loss ``mean_i(1 - s_ii + max_{j!=i} relu(s_ij))`` and gradients for both towers.

    ``code_p is query_p`` for the siamese model; gradients then accumulate in
    one dictionary. Returns (loss, code_grads, query_grads, stats).
    """
    n = code_ids.shape[0]

    def mask(dim):
        if dropout <= 0 or rng is None:
            return None
        return (rng.random((n, dim)) >= dropout) / (1.0 - dropout)

    hdim = code_p["fc_weight"].shape[0]
    c, c_cache = _forward(code_p, code_ids, mask(hdim))
    q, q_cache = _forward(query_p, query_ids, mask(hdim))
    cu, cn = _unit(c)
    qu, qn = _unit(q)
    s = qu @ cu.T
    gs = np.zeros_like(s)
    gs[np.arange(n), np.arange(n)] = -1.0 / n
    neg = 0.0
    if n > 1:
        off = np.where(np.eye(n, dtype=bool), -np.inf, s)
        j = off.argmax(axis=1)
        best = off[np.arange(n), j]
        pos = best > 0
        gs[np.arange(n)[pos], j[pos]] += 1.0 / n
        neg = np.maximum(best, 0.0)
    loss = float(np.mean(1.0 - np.diag(s) + neg))
    dqu = gs @ cu
    dcu = gs.T @ qu
    dq = (dqu - qu * (qu * dqu).sum(axis=1, keepdims=True)) / qn
    dc = (dcu - cu * (cu * dcu).sum(axis=1, keepdims=True)) / cn
    zeros = lambda p: {k: np.zeros(v.shape) for k, v in p.items() if k in PARAMS}  # noqa: E731   zeros_like of unpickled arrays is slow in add.at
    code_g = zeros(code_p)
    query_g = code_g if query_p is code_p else zeros(query_p)
    _backward(code_p, c_cache, dc, code_g)
    _backward(query_p, q_cache, dq, query_g)
    stats = {"code": (c_cache["mu"], c_cache["h"].var(axis=0, ddof=1) if n > 1 else c_cache["var"]),
             "query": (q_cache["mu"], q_cache["h"].var(axis=0, ddof=1) if n > 1 else q_cache["var"])}
    return loss, code_g, query_g, stats


# ------------------------------------------------------------ optimiser ----
@dataclass
class AdamW:
    """PyTorch-style AdamW with decoupled weight decay."""
    lr: float = config.LEARNING_RATE
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    weight_decay: float = 0.01
    t: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        b1, b2 = self.betas
        for k, g in grads.items():
            p = params[k]
            p *= 1.0 - self.lr * self.weight_decay
            m = self.m.setdefault(k, np.zeros_like(p))
            v = self.v.setdefault(k, np.zeros_like(p))
            m *= b1
            m += (1 - b1) * g
            v *= b2
            v += (1 - b2) * g * g
            mhat = m / (1 - b1 ** self.t)
            vhat = v / (1 - b2 ** self.t)
            p -= self.lr * mhat / (np.sqrt(vhat) + self.eps)


def clip_by_norm(grads: dict, max_norm: float | None) -> float:
    total = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    if max_norm is not None and total > max_norm:
        scale = max_norm / (total + 1e-6)
        for g in grads.values():
            g *= scale
    return total


# ---------------------------------------------------------- the Spark loop ----
def _init_params(spark: SparkSession, tower: str, vocab_size: int, emb: int, enc: int) -> dict:
    from lodestar.operators.encoder import load_towers, md5_weights
    t = load_towers(md5_weights(spark, tower, vocab_size, emb, enc))[tower]
    return {"embed": t.embed.copy(), "fc_weight": t.fc_w.copy(), "fc_bias": t.fc_b[None, :].copy(),
            "bn_weight": np.ones((1, enc)), "bn_bias": np.zeros((1, enc)),
            "bn_mean": np.zeros((1, enc)), "bn_var": np.ones((1, enc))}


def _step_kernel(bc, dropout: float, seed: int, epoch: int, shared: bool):
    """Kernel of one mini-batch: ``(batch_id, rows, loss, statistics, gradients)``, gradients as ``{tower: {param: (rows, values)}}``."""
    def run(pdf: pd.DataFrame) -> tuple:
        towers = bc.value
        code_t, query_t = ("shared", "shared") if shared else ("code", "query")
        pdf = pdf.sort_values("row_id")
        bid = int(pdf["batch_id"].iloc[0])
        rng = np.random.default_rng([seed, epoch, bid])
        ci = np.stack([np.asarray(v, dtype=np.int64) for v in pdf["code_ids"]])
        qi = np.stack([np.asarray(v, dtype=np.int64) for v in pdf["query_ids"]])
        met = np.union1d(0, np.concatenate([ci.reshape(-1), qi.reshape(-1)]))           # the pad row stays the first one
        local = {t: {**p, "embed": p["embed"][met]} for t, p in towers.items()}
        loss, cg, qg, stats = loss_and_grads(local[code_t], local[query_t], np.searchsorted(met, ci), np.searchsorted(met, qi), dropout, rng)
        grads: dict = {}
        for tname, g in ((code_t, cg),) if shared else ((code_t, cg), (query_t, qg)):
            touched = np.flatnonzero(np.abs(g["embed"]).sum(axis=1))
            grads[tname] = {k: (np.arange(len(mat)), mat) if k != "embed" else (met[touched], mat[touched]) for k, mat in g.items()}
        return bid, len(pdf), loss, stats, grads
    return run


def _add(total: dict, grads: dict) -> None:
    for t, params in grads.items():
        for k, (rows, vals) in params.items():
            total[t][k][rows] += vals               # a row stands once


def _lane(run, shapes: dict):
    """A partition's mini-batches in order: their gradients added up, and a row each with loss and statistics."""
    def task(rows) -> Iterator[tuple]:
        table = pd.DataFrame([r for _, r in rows], columns=["batch_id", "row_id", "code_ids", "query_ids"])
        for c in ("code_ids", "query_ids"):
            table[c] = [np.frombuffer(v, np.int32) for v in table[c]]
        found = [run(pdf) for _, pdf in table.groupby("batch_id", sort=True)]
        if len(found) == 1:
            yield [found[0][:4]], found[0][4]
        elif found:
            total = {t: {k: np.zeros(shape) for k, shape in params.items()} for t, params in shapes.items()}
            met: dict = {t: {k: [] for k in params} for t, params in shapes.items()}
            for *_, grads in found:
                _add(total, grads)
                for t, params in grads.items():
                    for k, (at, _) in params.items():
                        met[t][k].append(at)
            rows_of = {t: {k: np.unique(np.concatenate(at)) for k, at in params.items()} for t, params in met.items()}
            yield [f[:4] for f in found], {t: {k: (at, total[t][k][at]) for k, at in params.items()} for t, params in rows_of.items()}
    return task


def _dealt(table: DataFrame, batches_per_step: int) -> tuple[RDD, int, int]:
    """The rows by step and lane, a partition each; with the lanes of a step and the number of steps.

    A lane holds neighbouring mini-batches, their number fixed by ``batches_per_step``, so sums do not depend on the cluster.
    """
    own = math.ceil(batches_per_step / LANES)
    lanes = math.ceil(batches_per_step / own)
    last = table.agg(F.max("batch_id")).first()[0]
    n_steps = 0 if last is None else int(last) // batches_per_step + 1

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in ("code_ids", "query_ids"):
                pdf[c] = [np.asarray(v, np.int32).tobytes() for v in pdf[c]]
            yield pdf

    def place(row) -> tuple:
        step, at = divmod(row[0], batches_per_step)
        return step * lanes + at // own, (row[0], row[1], bytes(row[2]), bytes(row[3]))

    rows = table.select("batch_id", "row_id", "code_ids", "query_ids").mapInPandas(packed, "batch_id long, row_id long, code_ids binary, query_ids binary")
    return rows.rdd.map(place).partitionBy(max(n_steps * lanes, 1), lambda lane: lane), lanes, n_steps


def nbow_fit(batched: DataFrame, vocab_size: int = config.VOCAB_SIZE, embedding_dim: int = config.EMBEDDING_DIM,
             encoding_dim: int = config.ENCODING_DIM, lr: float = config.LEARNING_RATE, epochs: int = 1,
             batches_per_step: int = 64, clip: float | None = None, dropout: float = config.ENCODER_DROPOUT,
             shared: bool = True, seed: int = config.SEED, validate_fn=None, registry: str | None = None,
             run_id: str = "run", max_batches: int | None = None) -> tuple[dict, list[tuple]]:
    """E5: fit the NBOW towers on ``batched`` (``row_id, split, batch_id, code_ids, query_ids``).

    Trains on the ``train`` split. ``validate_fn(weights_df) -> (loss, mrr)``
    runs after every epoch when given; early stopping follows W5. Returns the
    final parameters (by tower) and the metric rows. With a ``registry`` folder
    the weights of every validated epoch and the metrics are stored there and the best
    epochs served. ``max_batches`` caps the training
    mini-batches per epoch (the sweep's batch limit).
    """
    from lodestar.operators.rowid import shuffle_rows
    from lodestar.operators.train import metrics_rows
    from lodestar.sources import runs
    spark = batched.sparkSession
    ship_package(spark)
    names = ["shared"] if shared else ["code", "query"]
    towers = {t: _init_params(spark, t, vocab_size, embedding_dim, encoding_dim) for t in names}
    opt = {t: AdamW(lr=lr) for t in names}
    shapes = {t: {k: v.shape for k, v in towers[t].items() if k in PARAMS} for t in names}
    metrics: list[tuple] = []
    best, wait = math.inf, 0
    train_rows = batched.where(F.col("split") == "train").select("row_id", "split", "split_pos", "code_ids", "query_ids")
    for epoch in range(epochs):
        shuffled = shuffle_rows(train_rows, epoch)
        table = shuffled.withColumn("batch_id", F.floor(F.col("shuffle_pos") / config.BATCH_SIZE).cast("bigint"))
        if max_batches is not None:
            table = table.where(F.col("batch_id") < max_batches)
        dealt, lanes, n_steps = _dealt(table, batches_per_step)
        losses = []
        for step in range(n_steps):
            bc = spark.sparkContext.broadcast(towers)        # model-sized
            task = _lane(_step_kernel(bc, dropout, seed, epoch, shared), shapes)
            found = spark.sparkContext.runJob(dealt, task, list(range(step * lanes, (step + 1) * lanes)))   # sums of a lane; per mini-batch: loss + BN stats
            side = [one for batches, _ in found for one in batches]
            grads = {t: {k: np.zeros(shape) for k, shape in shapes[t].items()} for t in names}
            for _, sums in found:
                _add(grads, sums)
            for t in names:
                for g in grads[t].values():
                    g /= max(len(side), 1)
                clip_by_norm(grads[t], clip)
                opt[t].step(towers[t], grads[t])
            for _, n, loss, stats in side:                   # in the order of the mini-batches
                for tower, (mean, var) in stats.items():
                    held = towers["shared" if shared else tower]
                    held["bn_mean"][0] = 0.9 * held["bn_mean"][0] + 0.1 * mean
                    held["bn_var"][0] = 0.9 * held["bn_var"][0] + 0.1 * var
                losses.append((loss, n))
                metrics += metrics_rows(run_id, "train", epoch, {"train/batch_loss": loss})
            bc.destroy()                                     # nothing of the step is computed again
        if losses:
            epoch_loss = sum(v * n for v, n in losses) / sum(n for _, n in losses)
            metrics += metrics_rows(run_id, "train", epoch, {"train/loss": epoch_loss})
        if validate_fn is not None:
            v_loss, v_mrr = validate_fn(weights_frame(spark, towers))
            metrics += metrics_rows(run_id, "valid", epoch, {"valid/loss": v_loss, "valid/mrr": v_mrr})
            if registry:
                runs.save_weights(weights_frame(spark, towers), registry, run_id, epoch)
            if not math.isfinite(v_loss):
                break
            if v_loss < best - config.EARLY_STOP_MIN_DELTA:
                best, wait = v_loss, 0
            else:
                wait += 1
                if wait >= config.EARLY_STOP_PATIENCE:
                    break
    if registry:
        steps: Counter = Counter()
        rows = []
        for run, split, epoch, name, value in metrics:
            rows.append((run, split, epoch, name, steps[epoch] if name == "train/batch_loss" else None, value))
            steps[epoch] += name == "train/batch_loss"
        runs.write_metrics(spark.createDataFrame(rows, runs.METRIC_SCHEMA), registry)
        runs.publish_best(spark, registry)
    return towers, metrics


def weights_frame(spark: SparkSession, towers: dict) -> DataFrame:
    """The trained parameters as a ``weights(param, row, values)`` table."""
    rows = []
    for t, p in towers.items():
        for k in ("embed", "fc_weight", "fc_bias", "bn_mean", "bn_var", "bn_weight", "bn_bias"):
            for i, r in enumerate(p[k]):
                rows.append((f"{t}/{k}", i, [float(x) for x in r]))
    return spark.createDataFrame(rows, "param string, row int, values array<double>")


def run_sweep(batched: DataFrame, trials: DataFrame, validate_fn, vocab_size: int = config.VOCAB_SIZE,
              epochs: int = 1, max_batches: int | None = None, batches_per_step: int = 64,
              run_col: str = "run_id") -> DataFrame:
    """Fit one NBOW model per trial row and report its validation loss.

    ``trials`` comes from ``train.sweep_trials`` (one row of hyper-parameters
    per trial, a small table); each trial is a full distributed ``nbow_fit``
    capped at ``max_batches`` mini-batches per epoch.
    ``validate_fn(weights_df) -> (loss, mrr)``. Returns
    ``(run_id, valid_loss, valid_mrr, is_best)``; the best trial has the lowest loss.
    """
    spark = batched.sparkSession
    results = []
    for t in trials.collect():                      # the trial table: a handful of rows
        towers, metrics = nbow_fit(batched, vocab_size=vocab_size, embedding_dim=int(t["embedding_dim"]),
                                   encoding_dim=int(t["encoding_dim"]), lr=float(t["learning_rate"]),
                                   epochs=epochs, batches_per_step=batches_per_step,
                                   clip=float(t["gradient_clip_val"]), dropout=float(t["encoder_dropout"]),
                                   max_batches=max_batches, validate_fn=validate_fn, run_id=str(t[run_col]))
        valid = [(v, name) for (_, split, _, name, v) in metrics if split == "valid"]
        loss = [v for v, name in valid if name == "valid/loss"][-1]
        mrr = [v for v, name in valid if name == "valid/mrr"][-1]
        results.append((t[run_col], float(loss), float(mrr)))
    best = min(results, key=lambda r: (r[1], r[0]))[0] if results else None
    rows = [(str(r), loss, mrr, r == best) for r, loss, mrr in results]
    return spark.createDataFrame(rows, "run_id string, valid_loss double, valid_mrr double, is_best boolean")

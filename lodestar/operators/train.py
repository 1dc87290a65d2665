"""Run metrics: checkpoint selection, early stopping, sweep trials.

Metric history is a long table ``(run_id, epoch, metric, value)`` or the
wide ``(run_id, epoch, valid_loss)`` used below.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar import config
from lodestar.functions.text import hash_uniform


def best_checkpoints(history: DataFrame, k: int = 3, run_col: str = "run_id",
                     value_col: str = "valid_loss", epoch_col: str = "epoch") -> DataFrame:
    """The ``k`` lowest validation losses per run (ties: earlier epoch).

    ``row_number() <= k`` plans as a WindowGroupLimit: each map task keeps its
    own top k per run before the shuffle, so a run with most of the rows
    costs k rows per task.
    """
    w = Window.partitionBy(run_col).orderBy(F.col(value_col).asc(), F.col(epoch_col).asc())
    return (history.withColumn("ckpt_rank", F.row_number().over(w))
                   .where(F.col("ckpt_rank") <= k)
                   .withColumn("ckpt_rank", F.col("ckpt_rank").cast("bigint")))


def early_stop_fold(history: DataFrame, min_delta: float = config.EARLY_STOP_MIN_DELTA,
               patience: int = config.EARLY_STOP_PATIENCE, run_col: str = "run_id",
               value_col: str = "valid_loss", epoch_col: str = "epoch") -> DataFrame:
    """Per run, the epoch at which training stops, and the best epoch/value.

    A check improves iff ``value < best - min_delta`` (then wait = 0), else
    ``wait += 1``; training stops when ``wait >= patience`` or the value is
    not finite. ``stop_epoch`` is NULL when the run never stops early.

    Reference form: folds one run's ordered checks with ``aggregate`` (the
    whole run in one group). ``early_stop`` gives the same answer without it.
    """
    init = F.struct(F.lit(math.inf).alias("best"), F.lit(None).cast("long").alias("best_epoch"),
                    F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop"))

    def step(acc, x):
        stopped = acc["stop"].isNotNull()
        v, e = x["v"], x["e"]
        finite = ~(F.isnan(v) | (v == F.lit(math.inf)) | (v == F.lit(-math.inf)))
        improved = finite & (v < acc["best"] - F.lit(min_delta))
        wait = F.when(improved, F.lit(0)).otherwise(acc["wait"] + 1)
        stop = F.when(~finite, e).when(~improved & (wait >= patience), e)
        return F.when(stopped, acc).otherwise(F.struct(
            F.when(improved, v).otherwise(acc["best"]).alias("best"),
            F.when(improved, e).otherwise(acc["best_epoch"]).alias("best_epoch"),
            wait.alias("wait"),
            stop.alias("stop")))

    seq = F.array_sort(F.collect_list(F.struct(F.col(epoch_col).cast("long").alias("e"),
                                               F.col(value_col).cast("double").alias("v"))))
    folded = history.groupBy(run_col).agg(F.aggregate(seq, init, step).alias("_s"),
                                          F.count(F.lit(1)).alias("n_checks"))
    return folded.select(run_col, F.col("_s.stop").alias("stop_epoch"),
                         F.col("_s.best_epoch").alias("best_epoch"),
                         F.when(F.col("_s.best_epoch").isNotNull(), F.col("_s.best")).alias("best_value"),
                         "n_checks")


def sweep_trials(runs: DataFrame, run_col: str = "run_id", seed: int = config.SEED) -> DataFrame:
    """E6 trial table: random-search hyper-parameters per trial from md5 uniforms.

    learning rate ``exp(U(-8, -1))``, clip ``U(0.8, 1.6)``, dropout
    ``U(0, 0.5)``, embedding and encoding dims drawn from (16, 32, 64, 128).
    """
    def u(name: str):
        return hash_uniform(F.concat_ws(":", F.lit(str(seed)), F.col(run_col).cast("string"), F.lit(name)))

    lo, hi = config.SWEEP_LOG_LR
    c0, c1 = config.SWEEP_CLIP
    d0, d1 = config.SWEEP_DROPOUT
    dims = F.array(*[F.lit(d) for d in config.SWEEP_DIMS])
    n = len(config.SWEEP_DIMS)
    return runs.select(
        run_col,
        F.exp(F.lit(lo) + F.lit(hi - lo) * u("learning_rate")).alias("learning_rate"),
        (F.lit(c0) + F.lit(c1 - c0) * u("gradient_clip_val")).alias("gradient_clip_val"),
        (F.lit(d0) + F.lit(d1 - d0) * u("encoder_dropout")).alias("encoder_dropout"),
        F.element_at(dims, (F.floor(u("embedding_dim") * n) + 1).cast("int")).alias("embedding_dim"),
        F.element_at(dims, (F.floor(u("encoding_dim") * n) + 1).cast("int")).alias("encoding_dim"),
    )


def best_trial(trials: DataFrame, results: DataFrame, run_col: str = "run_id",
               value_col: str = "valid_loss") -> DataFrame:
    """Each trial's best validation loss, and which trial is best overall."""
    per = results.groupBy(run_col).agg(F.min(value_col).alias("best_valid_loss"))
    scored = trials.join(per, run_col)
    best = scored.agg(F.min_by(F.col(run_col), F.struct("best_valid_loss", run_col))).first()[0]  # one value
    return scored.withColumn("is_best", F.col(run_col) == F.lit(best))


def metrics_rows(run_id: str, split: str, epoch: int, values: dict[str, float]) -> list[tuple]:
    """S12 row shape ``(run_id, split, epoch, metric, value)``."""
    return [(run_id, split, int(epoch), name, float(v)) for name, v in values.items()]


def early_stop(history: DataFrame, min_delta: float = config.EARLY_STOP_MIN_DELTA,
               patience: int = config.EARLY_STOP_PATIENCE, run_col: str = "run_id",
               value_col: str = "valid_loss", epoch_col: str = "epoch") -> DataFrame:
    """W5 without grouping a run: bounded look-ahead plus pointer jumping.

    Improvement epochs form a chain: from an improvement at ``e`` (value v),
    the next link is the first ``e' in (e, e + patience]`` with a value below
    ``v - min_delta``; a non-finite value there stops training at ``e'``, and
    no link stops it at ``e + patience`` (if the run reaches it). The look-ahead
    is an equi-join on ``(run, e + j)`` for ``j = 1..patience``; following the
    chain from a virtual epoch 0 (value +inf) takes ``ceil(log2(n))`` rounds
    of pointer jumping, each a join on the unique ``(run, epoch)`` key, with a
    checkpoint every second round. Epochs may start anywhere and have gaps:
    the checks are numbered 1..n in epoch order first, and the positions found
    are mapped back.
    """
    from lodestar.operators.rowid import rank_within
    from lodestar.session import checkpoint_root
    checkpoint_root(history.sparkSession)
    checks = history.select(F.col(run_col).alias("run"), F.col(epoch_col).cast("long").alias("epoch"),
                            F.col(value_col).cast("double").alias("v"))
    checks = rank_within(checks, ["run"], ["epoch"], "e").checkpoint(eager=True)
    h = checks.select("run", "e", "v")
    n_run = h.groupBy("run").agg(F.max("e").alias("n"), F.count(F.lit(1)).alias("n_checks"))
    nodes = h.unionByName(n_run.select("run", F.lit(0).cast("long").alias("e"), F.lit(math.inf).alias("v")))
    finite = lambda c: ~(F.isnan(c) | (c == F.lit(math.inf)) | (c == F.lit(-math.inf)))
    ahead = (nodes.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(patience))))
                  .withColumn("e2", F.col("e") + F.col("j"))
                  .join(h.select("run", F.col("e").alias("e2"), F.col("v").alias("v2")), ["run", "e2"]))
    hit = (~finite(F.col("v2"))) | (F.col("v2") < F.col("v") - F.lit(min_delta))
    first = (ahead.where(hit).groupBy("run", "e")
                  .agg(F.min("e2").alias("nxt")))       # group = one epoch's look-ahead (<= patience rows)
    nxt_v = h.select("run", F.col("e").alias("nxt"), F.col("v").alias("nv"))
    linked = (nodes.join(first, ["run", "e"], "left").join(nxt_v, ["run", "nxt"], "left")
                   .join(n_run.select("run", "n"), "run"))
    stop_here = F.when(F.col("nxt").isNotNull() & ~finite(F.col("nv")), F.col("nxt")) \
                 .when(F.col("nxt").isNull() & (F.col("e") + F.lit(patience) <= F.col("n")), F.col("e") + F.lit(patience))
    terminal = F.col("nxt").isNull() | ~finite(F.col("nv"))
    state = linked.select(
        "run", "e",
        F.when(terminal, F.lit(None).cast("long")).otherwise(F.col("nxt")).alias("ptr"),
        F.when(terminal, F.struct(stop_here.alias("stop"),
                                  F.when(F.col("e") > 0, F.col("e")).alias("best"))).alias("term"))
    state = state.checkpoint(eager=True)
    max_n = n_run.agg(F.max("n")).first()[0] or 0
    n_rounds = max(1, math.ceil(math.log2(max_n + 2)))
    for i in range(n_rounds):
        look = state.select("run", F.col("e").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("term").alias("term2"))
        state = (state.join(look, ["run", "ptr"], "left")
                      .select("run", "e",
                              F.when(F.col("term").isNull(), F.col("ptr2")).otherwise(F.lit(None).cast("long")).alias("ptr"),
                              F.coalesce(F.col("term"), F.col("term2")).alias("term")))
        if i % 2 == 1 or i == n_rounds - 1:      # cut the lineage every second round
            state = state.checkpoint(eager=True)
    root = state.where(F.col("e") == 0).select("run", F.col("term.stop").alias("stop_epoch"),
                                               F.col("term.best").alias("best_epoch"))
    best = checks.select("run", F.col("e").alias("best_epoch"), F.col("epoch").alias("_best"), F.col("v").alias("best_value"))
    stop = checks.select("run", F.col("e").alias("stop_epoch"), F.col("epoch").alias("_stop"))
    return (root.join(best, ["run", "best_epoch"], "left").join(stop, ["run", "stop_epoch"], "left")
                .join(n_run.select("run", "n_checks"), "run")
                .select(F.col("run").alias(run_col), F.col("_stop").alias("stop_epoch"),
                        F.col("_best").alias("best_epoch"), "best_value", "n_checks"))

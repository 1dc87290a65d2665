"""Run registry and metric sink (S11, S12, with T3's choice of checkpoints).

Layout under a registry root::

    metrics/run_id=R/split=S/epoch=E/     scalar metrics, replaced per (run, split, epoch)
    weights/run_id=R/epoch=E/version=V/   encoder weights, one folder per save
    served/V/                             (run_id, epoch, version, rank): the best epochs of every run
    CURRENT                               the name of the served table that counts

Weights are written to a fresh version folder, then metrics tell which epochs are best, then a new
served table is written, and the pointer file is swapped last by one rename. A reader follows the pointer, so it
sees the old or the new choice and never a half-written one; what no served table
names is removed after the swap.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import config
from lodestar.operators.train import best_checkpoints
from lodestar.sources.stores import delete_folder, path_exists, rename

METRIC_SCHEMA = "run_id string, split string, epoch int, metric string, step int, value double"      # step: null for a whole epoch
SERVED_SCHEMA = "run_id string, epoch int, version string, rank long"


# --------------------------------------------------------------- metrics ----
def write_metrics(rows: DataFrame, root: str) -> None:
    """Add metric rows; all rows of a (run, split, epoch) that exists are replaced, so a rerun changes nothing.

    Give all metrics of one (run, split, epoch) together; among equal names the largest value stands.
    """
    unknown = rows.where(~F.col("metric").isin(*config.METRIC_NAMES)).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown metric {unknown[0]['metric']!r}")
    (rows.groupBy("run_id", "split", "epoch", "metric", "step").agg(F.max("value").alias("value"))
         .repartition("run_id", "split", "epoch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_id", "split", "epoch").parquet(f"{root.rstrip('/')}/metrics"))


def log_metrics(spark: SparkSession, root: str, run_id: str, epoch: int, values: Mapping[str, float]) -> None:
    """The metrics of one epoch of a run, by name (``valid/loss``, ``test/mrr``, ...)."""
    rows = [(run_id, name.split("/")[0], epoch, name, None, float(v)) for name, v in values.items() if v is not None]
    write_metrics(spark.createDataFrame(rows, METRIC_SCHEMA), root)


def read_metrics(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root.rstrip('/')}/metrics"
    if not path_exists(spark, path):
        return spark.createDataFrame([], METRIC_SCHEMA)
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


# --------------------------------------------------------------- weights ----
def save_weights(weights: DataFrame, root: str, run_id: str, epoch: int) -> str:
    """The weights of one epoch as a new version; it is not served before ``publish_best`` names it."""
    version = uuid.uuid4().hex
    weights.write.parquet(f"{root.rstrip('/')}/weights/run_id={run_id}/epoch={epoch}/version={version}")
    return version


def _saved(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, epoch, version, changed)`` of every complete save, from the folder names."""
    pattern = f"{root.rstrip('/')}/weights/run_id=*/epoch=*/version=*/_SUCCESS"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    rows = []
    for status in found:
        parts = dict(p.split("=", 1) for p in status.getPath().toString().split("/") if "=" in p)
        rows.append((parts["run_id"], int(parts["epoch"]), parts["version"], int(status.getModificationTime())))
    return spark.createDataFrame(rows, "run_id string, epoch int, version string, changed long")


def publish_best(spark: SparkSession, root: str, k: int = 3) -> DataFrame:
    """S11 + T3: serve the ``k`` saved epochs of each run with the lowest ``valid/loss``; other weights are removed.

    Only finite losses count. Returns the served table.
    """
    root = root.rstrip("/")
    loss = read_metrics(spark, root).where((F.col("metric") == "valid/loss") & (F.abs("value") < math.inf) & ~F.isnan("value"))
    saved = _saved(spark, root)
    latest = saved.groupBy("run_id", "epoch").agg(F.max_by("version", F.struct("changed", "version")).alias("version"))
    history = latest.join(loss.select("run_id", "epoch", F.col("value").alias("valid_loss")), ["run_id", "epoch"])
    served = best_checkpoints(history, k).select("run_id", "epoch", "version", F.col("ckpt_rank").alias("rank"))
    name = uuid.uuid4().hex
    served.write.parquet(f"{root}/served/{name}")
    _swap(spark, root, name)
    kept = spark.read.schema(SERVED_SCHEMA).parquet(f"{root}/served/{name}")
    for r in saved.join(kept, ["run_id", "epoch", "version"], "left_anti").collect():     # one row a save that goes
        delete_folder(spark, f"{root}/weights/run_id={r['run_id']}/epoch={r['epoch']}/version={r['version']}")
    return kept


def _swap(spark: SparkSession, root: str, name: str) -> None:
    fresh = f"{root}/.current-{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(fresh)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    stream.writeBytes(name)
    stream.close()
    rename(spark, fresh, f"{root}/CURRENT", overwrite=True)


def served(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, epoch, version, rank)`` that the pointer names."""
    root = root.rstrip("/")
    if not path_exists(spark, f"{root}/CURRENT"):
        return spark.createDataFrame([], SERVED_SCHEMA)
    name = spark.read.text(f"{root}/CURRENT").first()["value"]
    return spark.read.schema(SERVED_SCHEMA).parquet(f"{root}/served/{name}")


def load_weights(spark: SparkSession, root: str, run_id: str, rank: int = 1) -> tuple[DataFrame, int]:
    """Weights and epoch of a run's best (or ``rank``-th best) checkpoint; only its folder is read."""
    row = served(spark, root).where((F.col("run_id") == run_id) & (F.col("rank") == rank)).first()
    if row is None:
        raise LookupError(f"no served checkpoint of run {run_id!r} under {root}")
    path = f"{root.rstrip('/')}/weights/run_id={run_id}/epoch={row['epoch']}/version={row['version']}"
    try:
        return spark.read.parquet(path), row["epoch"]
    except AnalysisException as gone:
        raise LookupError(f"the weights of run {run_id!r} were replaced while they were read; read again") from gone

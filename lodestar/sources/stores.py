"""Build-once stores on shared storage: corpus, tokens and vocabulary.

A store folder is named by a key: the sha256 of the input files (path, length,
modification time) and of all parameters. A build writes into a fresh folder beside it and
publishes the whole by one rename that fails if the target exists. So a key's folder is complete
or absent: a job that dies between write and publish leaves only a
``.building-`` folder that nobody reads, and of two writers the later one drops its copy and
reads the published one. Existence checks and renames go through the Hadoop file system of the
path (the rename is atomic on HDFS and local disks; on an object store use its committer's table format).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import config
from lodestar.operators import bpe


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


def delete_folder(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Rename in one step; False if ``target`` exists and is not to be overwritten."""
    jvm = spark.sparkContext._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, source), _path(spark, target), options)
    except Py4JJavaError as failure:
        if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
            return False
        raise
    return True


def input_key(inputs: list[DataFrame], **parameters: Any) -> str:
    """Key of a build: the files that the inputs read, as the file system describes them, and the parameters.

    No data is read. The inputs must be plain scans; what is done to them belongs into the parameters.
    """
    described = []
    for df in inputs:
        spark = df.sparkSession
        for f in sorted(df.inputFiles()):
            status = _files(spark, f).getFileStatus(_path(spark, f))
            described.append((f, status.getLen(), status.getModificationTime()))
    text = json.dumps([described, sorted(parameters.items())], default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def build_folder(spark: SparkSession, root: str, name: str, key: str, write: Callable[[str], None]) -> str:
    """The published folder ``{root}/{name}/{key}``; ``write(folder)`` fills it if it is absent."""
    target = f"{root.rstrip('/')}/{name}/{key}"
    if path_exists(spark, target):
        return target
    fresh = f"{root.rstrip('/')}/{name}/.building-{key[:16]}-{uuid.uuid4().hex}"
    write(fresh)
    if not rename(spark, fresh, target):
        delete_folder(spark, fresh)             # another writer was first
    return target


def materialize_once(spark: SparkSession, root: str, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """One table, built only when its key's folder is absent, then read."""
    return spark.read.parquet(build_folder(spark, root, name, key, lambda folder: build().write.parquet(folder)))


# ------------------------------------------------------------ vocabulary ----
def save_vocab(model: bpe.BpeModel, spark: SparkSession, path: str) -> None:
    """Tokenizer state as two small Parquet tables."""
    model.vocab_frame(spark).write.mode("errorifexists").parquet(f"{path}/vocab")
    model.merges_frame(spark).write.mode("errorifexists").parquet(f"{path}/merges")


def load_vocab(spark: SparkSession, path: str) -> bpe.BpeModel:
    return bpe.BpeModel.from_frames(spark.read.parquet(f"{path}/vocab"), spark.read.parquet(f"{path}/merges"))


def vocab_once(pairs: DataFrame, root: str, train: Callable[[], bpe.BpeModel], **parameters: Any) -> bpe.BpeModel:
    """The tokenizer of a stored corpus, trained only when there is none for its files and parameters."""
    spark = pairs.sparkSession
    key = input_key([pairs], kind="vocab", **parameters)
    return load_vocab(spark, build_folder(spark, root, "vocab", key, lambda folder: save_vocab(train(), spark, folder)))


# ---------------------------------------------------------------- tokens ----
def token_cache(pairs: DataFrame, root: str, model: bpe.BpeModel, *, code_len: int = config.CODE_LENGTH,
                query_len: int = config.QUERY_LENGTH, **parameters: Any) -> DataFrame:
    """``row_id, code_ids, query_ids`` of a stored corpus, tokenized once.

    The key holds the corpus files, the tokenizer, both sequence lengths and any further
    parameters (size, encoder, code language, natural languages).
    """
    key = input_key([pairs], kind="tokens", model=model.fingerprint(), code_len=code_len, query_len=query_len, **parameters)
    return materialize_once(pairs.sparkSession, root, "tokens", key, lambda: bpe.tokenize_fields(
        pairs, model, code_len, query_len).select(F.col("row_id"), "code_ids", "query_ids"))

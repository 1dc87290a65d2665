"""Incremental corpus ingestion with Structured Streaming (S1/S2/S8 for growing raw data).

New raw split files (gzip JSON lines) are picked up exactly once: the file
source records what it has read in the checkpoint, the projection (P1) runs
per micro-batch, and the Parquet sink commits each batch atomically. With
``availableNow`` the query drains what is there and stops, so a scheduled job
only ever processes files it has not seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.corpus import corpus_projection
from lodestar.sources.files import RAW_SCHEMA, parsed_lines, tag_split


def ingest_splits(spark: SparkSession, raw_root: str, code_lang: str, sink_path: str, checkpoint: str,
                  max_files_per_trigger: int = 64) -> int:
    """Project every not-yet-seen raw file under ``{raw_root}/{code_lang}/final/jsonl/*``
    into the corpus table at ``sink_path``. Returns the number of micro-batches run."""
    src = (spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
                .text(f"{raw_root.rstrip('/')}/{code_lang}/final/jsonl/*"))
    rows = parsed_lines(src, RAW_SCHEMA, F.col("_metadata.file_path").alias("_path"))
    projected = corpus_projection(tag_split(rows, F.col("_path")).drop("_path"))
    q = (projected.writeStream.format("parquet").option("path", sink_path)
                  .option("checkpointLocation", checkpoint).outputMode("append")
                  .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(q.recentProgress)


def read_corpus(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.parquet(sink_path)

"""File sources and sinks: gzip JSON lines, split directories, annotation CSV, query lists.

Schemas are always explicit (no inference pass over the data). Gzip files are
not splittable, so a reader of few large files should repartition after the
scan; writers produce one gzip file per task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from lodestar import config
from lodestar.functions.text import strip

RAW_SCHEMA = StructType([
    StructField("url", StringType()),
    StructField("func_name", StringType()),
    StructField("code_tokens", ArrayType(StringType())),
    StructField("docstring_tokens", ArrayType(StringType())),
    StructField("docstring", StringType()),
])

DEFINITION_SCHEMA = StructType([
    StructField("url", StringType()),
    StructField("identifier", StringType()),
    StructField("function_tokens", ArrayType(StringType())),
    StructField("docstring_tokens", ArrayType(StringType())),
])

ANNOTATION_SCHEMA = StructType([
    StructField("Language", StringType()),
    StructField("Query", StringType()),
    StructField("GitHubUrl", StringType()),
    StructField("Relevance", DoubleType()),
])


def parsed_lines(lines: DataFrame, schema: StructType, *others: Column) -> DataFrame:
    """JSON objects from ``lines(value)``: a malformed line or an absent field is an error.

    A field must be there, as a key access needs it; its value may be null.
    Blank lines are skipped.
    """
    wanted = F.array(*[F.lit(f.name) for f in schema.fields])
    absent = F.array_except(wanted, F.json_object_keys("value"))
    lost = F.raise_error(F.concat(F.lit("missing fields in a JSON line: "), F.array_join(absent, ", ")))
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return (lines.where(F.length(F.trim("value")) > 0)
                 .select(F.when(F.size(absent) > 0, lost).otherwise(row).alias("_r"), *others)
                 .select("_r.*", *[c for c in ("_path",) if others]))


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema: StructType) -> DataFrame:
    """JSON lines (gzip or plain), one object per line, UTF-8, every field required."""
    return parsed_lines(spark.read.text([paths] if isinstance(paths, str) else list(paths)), schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S3: gzip JSON lines (one file per task); null values are written out."""
    df.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def split_dir(root: str, code_lang: str, split: str) -> str:
    """``{language}/final/jsonl/{split}`` under ``root``."""
    return f"{root.rstrip('/')}/{code_lang}/final/jsonl/{split}"


def scan_splits(spark: SparkSession, root: str, code_lang: str,
                splits: Sequence[str] = config.SPLIT_NAMES, schema: StructType = RAW_SCHEMA) -> DataFrame:
    """Every file of every split directory in one scan, tagged.

    ``split`` comes from the file path (hidden ``_metadata`` column) and
    ``split_order`` is its place in ``splits`` (train, valid, test), so the
    union keeps the reference's split order as a column, not as file order.
    """
    dirs = [split_dir(root, code_lang, s) for s in splits]
    df = parsed_lines(spark.read.text(dirs), schema, F.col("_metadata.file_path").alias("_path"))
    return tag_split(df, F.col("_path"), splits).drop("_path")


def tag_split(df: DataFrame, path: Column, splits: Sequence[str] = config.SPLIT_NAMES) -> DataFrame:
    """Add ``split`` and ``split_order`` from the path of a row's file."""
    split = F.regexp_extract(path, r"/final/jsonl/([^/]+)/", 1)
    order = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(splits))):
        order = F.when(split == s, F.lit(i)).otherwise(order)
    return df.withColumn("split", split).withColumn("split_order", order)


def write_splits(df: DataFrame, root: str, code_lang: str, split_col: str = "split",
                 splits: Sequence[str] = config.SPLIT_NAMES, project: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write a frame carrying a split column as the raw split directory layout.

    The input is persisted for the three filtered writes so it is computed once. ``project`` makes the
    written columns from a split's rows, so that wide ones are neither moved nor persisted.
    """
    cached = df.persist()
    try:
        for s in splits:
            rows = cached.where(F.col(split_col) == s).drop(split_col)
            write_jsonl(project(rows) if project else rows, split_dir(root, code_lang, s))
    finally:
        cached.unpersist()


def read_annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV ``Language, Query, GitHubUrl, Relevance``."""
    return (spark.read.schema(ANNOTATION_SCHEMA).option("header", True).option("multiLine", True)
                 .option("escape", '"').option("mode", "FAILFAST").csv(path))


def write_annotations_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, stripped on both sides; blank lines kept."""
    return spark.read.text(path).select(strip("value").alias("value"))


def write_lines(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).alias("value")).write.text(path)


def definitions_source(spark: SparkSession, paths: str | Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The de-duplicated definition set (search corpus) from Parquet or JSON."""
    if fmt == "json":
        return read_jsonl(spark, paths, DEFINITION_SCHEMA)
    return spark.read.schema(DEFINITION_SCHEMA).parquet(*([paths] if isinstance(paths, str) else paths))

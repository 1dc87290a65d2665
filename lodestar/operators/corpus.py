"""Corpus projections and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import join_tokens


def _joined(col: str) -> Column:
    """The token list joined by blanks; a null inside it is an error, as ``" ".join`` would make it.

    The check is part of the projected value: array_join alone drops nulls, and
    a check in a column of its own would be pruned.
    """
    has_null = F.exists(F.col(col), lambda x: x.isNull())
    return F.when(has_null, F.raise_error(F.lit(f"null token in {col}"))).otherwise(join_tokens(col))


def corpus_projection(raw: DataFrame, *others: str) -> DataFrame:
    """``url, func_name->identifier, join(code_tokens)->code, join(docstring_tokens)->query``; ``others`` stay as they are."""
    keep = [c for c in ("row_id", "split", "split_order", *others) if c in raw.columns]
    return raw.select("url", F.col("func_name").alias("identifier"), _joined("code_tokens").alias("code"),
                      _joined("docstring_tokens").alias("query"), *keep)


def eval_projection(definitions: DataFrame) -> DataFrame:
    """The same projection from the definition fields; no language filter."""
    keep = [c for c in ("row_id",) if c in definitions.columns]
    return definitions.select("url", "identifier", _joined("function_tokens").alias("code"),
                              _joined("docstring_tokens").alias("query"), *keep)


def project_field(df: DataFrame, field: str, id_col: str = "row_id") -> DataFrame:
    """One text field to tokenize (column pruning reaches the scan)."""
    return df.select(id_col, F.col(field).alias("text"))


def corpus_select(training: bool, corpus: DataFrame, evaluation: DataFrame) -> DataFrame:
    """P10: the training corpus when training, the evaluation set otherwise."""
    return corpus if training else evaluation


def text_stream(df: DataFrame, fields: tuple[str, ...] = ("code", "query"), id_col: str = "row_id") -> DataFrame:
    """Code and query values as one column in one scan (no union of two scans)."""
    arr = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(id_col, F.inline(arr))


def label_intersection(pred_labels, wanted_labels) -> Column:
    """The predicted label set shares at least one label with the wanted set."""
    return F.arrays_overlap(pred_labels, wanted_labels)


def align_pairs(code_tokens: DataFrame, query_tokens: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Separately tokenized fields re-aligned on the row id (inner join)."""
    return code_tokens.join(query_tokens, id_col)

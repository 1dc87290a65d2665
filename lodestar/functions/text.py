"""Scalar text functions (JVM-side Column expressions, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Pre-token pattern: runs of letter/mark/digit/underscore characters, or runs of
# anything else that is not whitespace. Whitespace is dropped. Written with
# Unicode classes so Spark (Java regex) and DuckDB (RE2) agree.
PRETOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def join_tokens(tokens: Column | str) -> Column:
    """``" ".join(tokens)``."""
    return F.array_join(_c(tokens), " ")


def strip_newlines(text: Column | str) -> Column:
    """Newlines become spaces (never glue two words together)."""
    return F.regexp_replace(_c(text), "\n", " ")


def strip(text: Column | str) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace removed."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"^\s+", ""), r"\s+$", "")


def normalize_query(text: Column | str) -> Column:
    """Lower-case and strip."""
    return F.lower(strip(text))


def capitalize(text: Column | str) -> Column:
    """C4: first character upper-case, the rest lower-case."""
    t = _c(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))


def nl_key(langs: Column | str) -> Column:
    """``"_".join(langs)`` or ``all`` when the list is empty or null."""
    return F.coalesce(F.nullif(F.array_join(_c(langs), "_"), F.lit("")), F.lit("all"))


def nl_key_of(langs: Sequence[str] | None) -> str:
    """C5 for a Python list (used to build paths on the driver)."""
    return "_".join(langs) if langs else "all"


def run_id(ts: Column | str) -> Column:
    """Run names of the form ``yyMMdd_HHmm``."""
    return F.date_format(_c(ts), "yyMMdd_HHmm")


def format_path(template: str, *cols: Column | str) -> Column:
    """``format_string`` path templates (``%s`` placeholders)."""
    return F.format_string(template, *[_c(c) for c in cols])


def first_line(text: Column | str) -> Column:
    """Text up to (not including) the first newline."""
    return F.substring_index(_c(text), "\n", 1)


def pretokens(text: Column | str) -> Column:
    """B1: split into word runs and punctuation runs; whitespace dropped."""
    return F.regexp_extract_all(_c(text), F.lit(PRETOKEN_PATTERN), 0)


def hash_uniform(key: Column | str) -> Column:
    """U[0,1) from the first 32 bits of ``md5(key)``; identical in DuckDB."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_order_key(seed: int | str, *parts: Column | str) -> Column:
    """``md5('seed:part1:part2...')`` as a sortable string."""
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces.append(_c(p).cast("string"))
    return F.md5(F.concat_ws(":", *pieces))

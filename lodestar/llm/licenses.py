"""License scans by an exact set-similarity join of text blocks with notice templates.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters.
A text block is a window of ``BLOCK_WORDS`` words that begins at every half of that, so
a notice of up to half a block lies whole in one, however it is wrapped. A
block meets a template if it holds at least ``THRESHOLD`` of the template's
distinct words (containment). The join is exact and follows prefix filtering:

* tokens of the templates are ordered by the number of documents of the whole table
  that hold them, rarest first (ties by token);
* a block that meets a template of n tokens with at least m of them shares one of its
  n - m + 1 first tokens: only blocks with such a token are built, and they meet the
  templates in an equi-join on it;
* length filter: a block needs m distinct words;
* positional filter: from the first shared token on, both sides must have enough
  tokens left;
* what remains is verified on the whole sets.

The base phrases are found word by word. The templates are a parameter of bounded size
(at most ``MAX_TEMPLATES`` of at most half a block each), so their tokens may be literals
and their prefixes a broadcast table. Texts are read twice (order, join) and never
shuffled; only blocks with a rare token are.

DataFrame functions only. Defined results: null and empty texts have no words, no places, no labels and
score 0. Rows are told apart by their own number, so repeated or null doc_ids are
judged each. Ties between templates add all their labels. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import let, pinned

# --- fixed values: base phrases, and notices as their licenses word them ----------
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = (
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# ------------------------------------------------------------------------------------
THRESHOLD = 0.8
BLOCK_WORDS = 128
MAX_TEMPLATES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    tokens: tuple[str, ...]           # distinct, in order of their first place
    need: int                         # tokens a block must hold


def templates(notices: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    out = []
    for number, (label, text) in enumerate(notices):
        found = re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
        if not 0 < len(found) <= BLOCK_WORDS // 2 or number >= MAX_TEMPLATES:
            raise ValueError(f"a template needs 1 to {BLOCK_WORDS // 2} words, and there may be {MAX_TEMPLATES}: {text!r}")
        tokens = tuple(dict.fromkeys(found))
        out.append(Template(number, label, tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9))))
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def token_order(df: DataFrame, notices: Sequence[Template], text_col: str = "text") -> list[str]:
    """The templates' tokens by the number of documents that hold them, then by token."""
    vocabulary = sorted({t for n in notices for t in n.tokens})
    held = df.select(F.explode(F.array_intersect(words(F.col(text_col)), _literals(vocabulary))).alias("token"))
    counted = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row a token
    return sorted(vocabulary, key=lambda t: (counted.get(t, 0), t))


def _places(found: Column) -> Column:
    """Structs ``(at, label)`` of the base phrases in an array of words."""
    def of(phrase: str, label: str) -> Column:
        parts = phrase.split(" ")

        def begins(i: Column) -> Column:
            hit = F.lit(True)
            for k, part in enumerate(parts):
                hit = hit & (F.get(found, i + k) == part)
            return F.coalesce(hit, F.lit(False))

        at = F.filter(F.transform(found, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
        return F.transform(F.filter(at, begins), lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

    ends = sorted({p.split(" ")[-1] for p in PHRASES})
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    every = F.concat(*[of(p, label) for p, label in PHRASES.items()])
    return F.when(F.arrays_overlap(found, _literals(ends)), every).otherwise(none)      # most texts hold none of the last words


def _blocks(found: Column, rare: Sequence[str], order: Sequence[str], least: int) -> Column:
    """Per block that holds a rare token and ``least`` words: its number of words and its template tokens in the global order."""
    half = BLOCK_WORDS // 2

    def block(i: Column) -> Column:
        return let(F.array_distinct(F.slice(found, i * half + 1, BLOCK_WORDS)), lambda w: F.when(
            F.arrays_overlap(w, _literals(rare)) & (F.size(w) >= least),
            F.struct(F.size(w).alias("size"), F.array_intersect(_literals(order), w).alias("tokens"))))

    none = F.array().cast("array<struct<size:int,tokens:array<string>>>")
    made = F.filter(F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / half).cast("int")), block), lambda b: b.isNotNull())
    return F.when(F.arrays_overlap(found, _literals(rare)), F.array_distinct(made)).otherwise(none)


def _met(blocks: DataFrame, notices: Sequence[Template], order: Sequence[str]) -> DataFrame:
    """``row, label, share`` of every (block, template) pair that meets the threshold."""
    rank = {t: k for k, t in enumerate(order)}
    rows = []
    for n in notices:
        ordered = sorted(n.tokens, key=rank.get)
        rows += [(t, p, n.label, ordered, len(ordered), n.need) for p, t in enumerate(ordered[:len(ordered) - n.need + 1])]
    prefixes = blocks.sparkSession.createDataFrame(rows, "token string, place int, label string, wanted array<string>, n int, need int")
    pairs = (blocks.select("row", "size", "tokens", F.posexplode("tokens").alias("at", "token"))
             .join(F.broadcast(prefixes), "token")               # at most MAX_TEMPLATES * BLOCK_WORDS / 2 rows
             .filter((F.col("size") >= F.col("need"))
                     & (F.least(F.size("tokens") - F.col("at"), F.col("n") - F.col("place")) >= F.col("need"))))
    shared = F.size(F.array_intersect("tokens", "wanted"))
    return pairs.withColumn("shared", shared).filter("shared >= need").select("row", "label", (F.col("shared") / F.col("n")).alias("share"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """License labels of every row: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` is the greatest containment among the blocks and templates that meet the threshold, 0 if none does.
    """
    wanted = templates(notices, threshold)
    order = token_order(df, wanted, text_col)
    rank = {t: k for k, t in enumerate(order)}
    rare = sorted({t for n in wanted for t in sorted(n.tokens, key=rank.get)[:len(n.tokens) - n.need + 1]}, key=rank.get)
    least = min((n.need for n in wanted), default=1)
    read = F.struct(F.size("_words").cast("long").alias("n_words"), _places(F.col("_words")).alias("places"),
                    _blocks(F.col("_words"), rare, order, least).alias("blocks"))
    judged = pinned(df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_col)).alias("_words"))
                    .select("id", "row", read.alias("r")).select("id", "row", "r.*"))
    blocks = judged.filter(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    found = (_met(blocks, wanted, order).groupBy(F.col("row").alias("_row"))
             .agg(F.collect_set("label").alias("_added"), F.max("share").alias("_share")))
    at, base = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    added = F.coalesce("_added", F.array().cast("array<string>"))
    return (judged.join(found, F.col("row") == F.col("_row"), "left")
            .select(F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
                    F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
                    _joined(base).alias("base_labels"), _joined(F.concat(base, added)).alias("labels"),
                    F.coalesce("_share", F.lit(0.0)).alias("score")))

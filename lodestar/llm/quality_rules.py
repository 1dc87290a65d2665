"""Quality rules, line first: clean the lines, then reject documents that lost too much.

Every line with a word is judged by three rules: punctuation (it is short and does not
end in a closing mark; a wide line that the next line carries on is judged by
the end of that wrapped block), navigation (bare
separators between fragments, or menu words only) and boilerplate (stock
phrases of licences, cookie notices and the like make up a set share of its words). Failing lines go. A document
is rejected when fewer than ``min_kept`` of its word characters survive, or
when it fails a base rule: fewer than ten words, or more than a fifth of them
inside repeated five-word windows.

DataFrame functions only, whole texts, no shuffle: every decision is local to a
row, and each is linear in the text but for one sort of the window hashes of
texts that repeat a window. Windows are compared by a 64-bit hash.

Defined results: null and empty texts have no words and fail the base rule.
Repeated rows and ties are judged row by row. Extra columns pass through
whatever their names; an input column with an output's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WHITESPACE, let, words_of

# --- fixed values -----------------------------------------------------------
SYMBOLS = "#*$%&|<>"
CLOSING = tuple(".!?…。！？:;,\"'”’»)]")
SEPARATORS = "|»›>•·/~-"
SEPARATOR_PATTERN = rf"(?<![^\x20\x09-\x0D])[{SEPARATORS}]+(?![^\x20\x09-\x0D])"
MENU_PATTERN = (r"(?i)^[\x20\x09-\x0D]*(?:(?:home|menu|login|log in|sign in|sign up|register|search|next|previous|"
                r"back|top|contact|about|help|faq|sitemap|share|print|subscribe)[\x20\x09-\x0D|»›>•·/~-]*)+$")
BOILERPLATE_PATTERN = (r"(?i)\b(?:cookie policy|uses? cookies|privacy policy|terms of (?:use|service)|"
                       r"all rights reserved|enable javascript|lorem ipsum|(?:licensed|released) under (?:the )?|"
                       r"copyright (?:\(c\)|©|[0-9]{4})|click here|read more|subscribe to our)")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
# ---------------------------------------------------------------------------

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
          "cleaned_text", "kept_chars", "kept")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules."""
    min_kept: float = 0.5          # share of the word characters that must survive
    max_unpunctuated: int = 30     # a longer line without a closing mark is a wrapped paragraph, not a fragment
    min_separators: int = 2        # bare separators that make a navigation line
    separator_share: float = 0.2   # and their share of the line's words
    min_wrapped: int = 30          # code points of a line that may go on in the next one
    stock_share: float = 0.2       # share of a line's words inside stock phrases that fails it


def _has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def _word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside ``width``-word windows that occur twice or more, first ones included."""

    def covered(windows: Column) -> Column:
        def count(marked: Column) -> Column:
            step = lambda acc, p: F.struct(
                (acc["n"] + p + width - F.greatest(p, acc["end"])).alias("n"), (p + width).alias("end"))
            return F.aggregate(marked, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

        def repeats(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return let(F.sort_array(F.transform(twice, lambda x: x["p"])), count)

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, repeats))

    shifted = [F.slice(words, k + 1, F.size(words) - width + 1).alias(str(k)) for k in range(width)]
    hashes = F.transform(F.arrays_zip(*shifted), lambda five: F.xxhash64(five))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(hashes, covered))


def _line_code(line: Column, following: Column, rules: LineRules) -> Column:
    """``m``: ends well; ``j``: may go on in the next line; ``x``: a fragment; ``b``: blank."""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    last = F.substring(F.rtrim(line, F.lit(WHITESPACE)), -1, 1)
    goes_on = ((F.length(line) >= rules.min_wrapped) & ~F.rlike(line, F.lit(f"[{SEPARATORS}]"))
               & F.coalesce(_has_word(following), F.lit(False)))
    return (F.when(last.isin(*CLOSING), "m").when(~_has_word(line), "b").when(n_words > rules.max_unpunctuated, "m")
            .when(goes_on, "j").otherwise("x"))


def well_ended(lines: Column, rules: LineRules) -> Column:
    """Per line, ``m`` if it or the last line of its wrapped block ends well."""
    codes = F.array_join(F.transform(lines, lambda line, i: _line_code(line, F.get(lines, i + 1), rules)), "")
    # Backwards, a run of j behind an m becomes m: each match starts at an m or where the last match ended.
    return F.split(F.reverse(F.regexp_replace(F.reverse(codes), r"(?:(?<=m)|(?!^)\G)j", "m")), "")


def failed_line(line: Column, ending: Column, rules: LineRules) -> Column:
    """Does the line (which has a word, and whose block's ending is known) fail a rule?"""
    # Conjunctions stop at the first false part: most lines end well and hold neither separators nor stock phrases.
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    separators = F.regexp_count(line, F.lit(SEPARATOR_PATTERN))
    navigation = ((F.rlike(line, F.lit(f"[{SEPARATORS}]")) & (separators >= rules.min_separators)
                   & (separators >= n_words * rules.separator_share)) | F.rlike(line, F.lit(MENU_PATTERN)))
    phrases = F.array_join(F.regexp_extract_all(line, F.lit(BOILERPLATE_PATTERN), 0), " ")
    stock = (F.rlike(line, F.lit(BOILERPLATE_PATTERN))
             & (F.regexp_count(phrases, F.lit(r"[^\x20\x09-\x0D]+")) >= n_words * rules.stock_share))
    return (ending != "m") | navigation | stock


def judge(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Add the columns FIELDS: base counts, cleaned text, surviving characters, verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"),
                        repeated_window_words(words).cast("long").alias("n_repeat_words"))

    def lines_of(lines: Column) -> Column:
        worded = F.filter(lines, _has_word)
        good = let(well_ended(lines, rules), lambda ends: F.filter(
            lines, lambda line, i: ~_has_word(line) | ~failed_line(line, F.get(ends, i), rules)))
        return F.struct((F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
                        F.array_join(good, "\n").alias("cleaned_text"))

    judged = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"),
        let(words_of(F.col(text_col)), counts).alias("_w"), let(F.split(text, "\n"), lines_of).alias("_l"),
        _word_chars(text).alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        text.alias("_text"))
    base_failed = ((F.col("_w.n_words") < MIN_WORDS)
                   | (100 * F.col("_w.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("_w.n_words")))
    cleaned = F.col("_l.cleaned_text")
    kept_chars = F.when(cleaned == F.col("_text"), F.col("word_chars")).otherwise(_word_chars(cleaned))
    names = [F.col(f"_in.`{c}`").alias(c) for c in df.columns if c not in FIELDS]
    return judged.select(
        *names, F.col("_w.n_words"), "word_chars", "n_symbols", F.col("_l.n_dup_lines"), F.col("_w.n_repeat_words"),
        base_failed.alias("base_failed"), F.col("_l.cleaned_text"), kept_chars.alias("kept_chars"),
        (~base_failed & (kept_chars >= F.col("word_chars") * rules.min_kept)).alias("kept"))


def clean(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Documents that pass, their failing lines removed; the input's columns."""
    judged = judge(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all"),
                             F.col(text_col).alias("_text")), "_text", rules).filter("kept")
    return judged.select(*[F.col("cleaned_text").alias(c) if c == text_col else F.col(f"_all.`{c}`").alias(c)
                           for c in df.columns])

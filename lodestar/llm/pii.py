"""Personal data by bootstrapped contextual extraction.

Base entities (email, ip, card, phone) come from fixed patterns. They and long
hexadecimal secrets are seeds: the two words before a seed are a lexical
pattern. Identifier-like strings that occur after a pattern are its instances.
Spark scores the pattern-instance graph in rounds: a pattern scores the share
of all its occurrences that known instances fill, an instance the noisy-or of
its patterns; seeds keep score one. What follows a pattern of high confidence
and enough support is a discovered identifier (kind ``id``).

A pattern's occurrences are counted over every word of every text, also of texts
that hold no instance: what a pattern mostly introduces is part of its score.

DataFrame functions only; a span's place comes from the lengths of matches and
of the pieces between them. Possessive patterns keep the matcher linear and its
stack flat on very long texts. The tables of patterns and instances are
aggregated on the map side and joined on plain keys; every round is
checkpointed.

Defined results: null texts count as empty and have no spans. Rows are told
apart by their own number, so repeated or null doc_ids are judged each. Ties and
repeated instances count once per (pattern, instance) with their number of
occurrences. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import flag_members, key_set, let, pinned, words_of

# --- fixed values: base kinds in their listed order -----------------------------
# The matches are those of the plain patterns; possessive forms and the guards
# "not inside a run, or right after a match" only spare hopeless starts.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET_PATTERN = r"^[0-9a-f]{32,64}$"
# -------------------------------------------------------------------------------
IDENTIFIER_PATTERN = r"(?<![A-Za-z0-9_])[A-Za-z0-9][A-Za-z0-9_-]{4,}+"
MIN_DIGITS = 4            # digits of an identifier-like string
CONTEXT_CHARS = 40        # longer contexts are no patterns
MIN_SUPPORT = 3.0         # summed score of a pattern's distinct instances
MIN_CONFIDENCE = 0.7
ROUNDS = 3
_BLOCK = 512
_DIGITS = "0123456789"


def _running(steps: Column, start: Column) -> Column:
    """Sums of the steps before each element, from ``start`` on."""
    def add(acc: Column, x: Column) -> Column:
        return F.struct(F.array_append(acc["a"], acc["s"]).alias("a"), (acc["s"] + x).alias("s"))
    return F.aggregate(steps, F.struct(F.array().cast("array<int>").alias("a"), start.cast("int").alias("s")), add, lambda acc: acc["a"])


def _offsets(steps: Column) -> Column:
    """``_running`` from 0 in blocks, so that long arrays are not copied per element."""
    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, _running(sums, F.lit(0)), _running))
    count = F.ceil(F.size(steps) / F.lit(_BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))


def matches(text: Column, pattern: str) -> Column:
    """All matches as structs ``(start, end, value)``, in code points, end exclusive."""
    def located(found: Column) -> Column:
        def spans(gaps: Column) -> Column:
            steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))
            begun = F.zip_with(_offsets(steps), F.slice(gaps, F.lit(1), F.size(found)), lambda s, g: s + F.length(g))
            return F.zip_with(begun, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))
        return let(F.split(text, pattern, -1), spans)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, none).otherwise(located(found)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda part: F.rlike(part, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & let(_digits(value), luhn)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base matches of each kind, in the listed order of kinds, then by start."""
    def of_kind(kind: str, pattern: str) -> Column:
        found = F.filter(matches(text, pattern), lambda m: _valid(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    return F.concat(*[of_kind(kind, pattern) for kind, pattern in PATTERNS.items()])


def _normal(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(F.lower(w), _DIGITS, "0" * 10))


def _left_pattern(text: Column, start: Column) -> Column:
    """The two words before the word that holds ``start``; null where there are none, or too long."""
    reach = F.lit(CONTEXT_CHARS * 3)
    before = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, reach))
    whole = F.regexp_replace(before, r"[^\x20\x09-\x0D]++$", "")
    # The first word of a cut-off stretch may be a part of one: two whole words need a third before them, or the text's begin.
    near = lambda w: F.when(F.size(w) >= 2, _context(F.element_at(w, -2), F.element_at(w, -1)))
    return let(_normal(words_of(whole)), lambda w: F.when((start <= reach) | (F.size(w) > 2), near(w)).otherwise(
        let(F.reverse(F.substring(text, F.lit(1), start)), _far_pattern)))


def _far_pattern(backwards: Column) -> Column:
    """The pattern from all the text before a span, read backwards."""
    word, gap = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
    pair = [F.reverse(F.regexp_extract(backwards, f"^{word}*+{gap}++({word}++){gap}++({word}++)", k)) for k in (2, 1)]
    return F.when(F.length(pair[0]) > 0, let(_normal(F.array(*pair)), lambda w: _context(F.get(w, F.lit(0)), F.get(w, F.lit(1)))))


def _context(first: Column, second: Column) -> Column:
    both = F.concat_ws(" ", first, second)
    return F.when(F.length(both) <= CONTEXT_CHARS, both)


def _has_entity(text: Column) -> Column:
    return F.rlike(text, F.lit("[0-9@]"))


def _occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row, numbered, with its base spans and its identifier-like strings, each with its pattern; no text."""
    text = F.col("_text")
    span = "array<struct<kind:string,start:int,end:int,value:string,pattern:string>>"

    def placed(t: Column) -> Column:
        ids = F.filter(matches(t, IDENTIFIER_PATTERN), lambda m: F.length(_digits(m["value"])) >= MIN_DIGITS)
        ids = F.transform(ids, lambda m: F.struct(F.lit("id").alias("kind"), m["start"].alias("start"),
                                                  m["end"].alias("end"), m["value"].alias("value")))
        return F.transform(F.concat(base_spans(t), ids), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            _left_pattern(t, s["start"]).alias("pattern")))

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = F.when(_has_entity(text), let(text, placed).cast(span)).otherwise(F.array().cast(span))
    return rows.select("id", F.monotonically_increasing_id().alias("row"), found.alias("found"))


def _pattern_counts(df: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(pattern, n_all)``: how often each wanted pattern stands before any word."""
    texts = df.select(F.col(text_col).alias("t"))
    contexts = let(_normal(words_of(F.col("t"))), lambda w: F.when(F.size(w) > 2, F.transform(
        F.sequence(F.lit(2), F.size(w) - 1), lambda i: _context(F.get(w, i - 2), F.get(w, i - 1)))))
    seen = texts.select(F.explode(contexts).alias("pattern")).filter("pattern is not null")
    # The bitmap lets no wanted pattern go, and keeps most others out of the shuffle; the join is exact.
    near = flag_members(seen, key_set(wanted, ["pattern"]), "near").filter("near")
    counted = near.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_all"))
    return counted.join(wanted, "pattern", "left_semi")


def score_patterns(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``(pattern, score)`` after ``rounds`` passes over ``edges(pattern, instance, n, seed)``."""
    graph = pinned(edges.join(totals, "pattern"))
    instances = graph.select("pattern", "instance", "n", "n_all", "seed", F.col("seed").cast("double").alias("score"))
    patterns = None
    for k in range(rounds):
        supported = F.sum("score") >= min_support
        patterns = pinned(instances.groupBy("pattern").agg(F.when(
            supported, F.least(F.sum(F.col("n") * F.col("score")) / F.first("n_all"), F.lit(1.0))).otherwise(0.0).alias("ps")))
        if k == rounds - 1:
            break
        keyed = patterns.select(F.concat("pattern", F.lit("")).alias("_p"), "ps")
        scored = graph.filter("not seed").join(keyed, F.col("pattern") == F.col("_p"))
        miss = F.exp(F.sum(F.log1p(-F.least(F.col("ps"), F.lit(0.999999)))))
        noisy = scored.groupBy("instance").agg((1 - miss).alias("score")).select(F.concat("instance", F.lit("")).alias("_i"), "score")
        unseen = graph.filter("not seed").join(noisy, F.col("instance") == F.col("_i")).select(
            "pattern", "instance", "n", "n_all", "seed", "score")
        instances = pinned(graph.filter("seed").select("pattern", "instance", "n", "n_all", "seed", F.lit(1.0).alias("score"))
                           .unionByName(unseen))
    return patterns.select("pattern", F.col("ps").alias("score"))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = MIN_CONFIDENCE,
         min_support: float = MIN_SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``id_col, base, added``, arrays of ``(kind, start, end, value)``."""
    rows = pinned(_occurrences(df, id_col, text_col))       # the checkpoint pins the row numbers
    spans = rows.select("row", F.explode("found").alias("s")).select("row", "s.*")
    # An identifier-like string inside or across a base span is that entity, not a new one.
    inside = "(partition by row order by start, end desc rows between unbounded preceding and 1 preceding)"
    later = "(partition by row order by start desc, end rows between unbounded preceding and 1 preceding)"
    base = F.col("kind") != "id"
    marked = (spans.withColumn("base_end", F.when(base, F.col("end"))).withColumn("base_start", F.when(base, F.col("start")))
              .withColumn("reach", F.expr(f"max(base_end) over {inside}")).withColumn("next", F.expr(f"min(base_start) over {later}")))
    overlaps = ~base & ((F.coalesce("reach", F.lit(-1)) > F.col("start")) | (F.coalesce("next", F.lit(1 << 30)) < F.col("end")))
    spans = pinned(marked.filter(~overlaps).select("row", "kind", "start", "end", "value", "pattern"))
    seed = (F.col("kind") != "id") | F.rlike("value", F.lit(SECRET_PATTERN))
    known = spans.filter("pattern is not null")
    edges = known.groupBy("pattern", F.col("value").alias("instance")).agg(
        F.count(F.lit(1)).alias("n"), F.max(seed).alias("seed"))
    edges = pinned(edges)
    wanted = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_support).select("pattern")
    wanted = pinned(wanted)
    totals = _pattern_counts(df, text_col, wanted)
    good = (score_patterns(edges, totals, rounds, min_support).filter(F.col("score") >= min_confidence)
            .select(F.concat("pattern", F.lit("")).alias("_p")))
    added = (spans.filter(F.col("kind") == "id").join(good, F.col("pattern") == F.col("_p"), "left_semi")
             .groupBy(F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "value"))).alias("_new")))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    new = F.transform(F.coalesce("_new", F.array()), lambda s: F.struct(
        F.lit("id").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return rows.join(added, F.col("row") == F.col("_row"), "left").select(
        F.col("id").alias(id_col), F.transform(F.filter("found", lambda s: s["kind"] != "id"), plain).alias("base"), new.alias("added"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Substring dedup: its definition by plain loops, and planted passages of 50 words and more."""

import hashlib
import random
import re

from lodestar.llm import line_dedup

WS = " \t\n\x0b\x0c\r"


def clauses(text):
    """``(start, end, words)`` of every unit, word by word."""
    tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, open_ = [], []
    for k, token in enumerate(tokens):
        open_.append(token)
        gap = text[token[1]:tokens[k + 1][0]] if k + 1 < len(tokens) else ""
        if token[2][-1] in ".,;:!?" or gap.count("\n") > 1 or k + 1 == len(tokens):
            pieces, piece = [], []
            for t in open_:
                piece.append(t)
                low = re.sub("[A-Z]", lambda m: m.group().lower(), t[2])
                if len(open_) > 24 and hashlib.md5(low.encode()).digest()[0] % 8 == 0:
                    pieces.append(piece)
                    piece = []
            out += [p for p in [*pieces, piece] if p]
            open_ = []
    return [(c[0][0], c[-1][1], [re.sub("[A-Z]", lambda m: m.group().lower(), w) for _, _, w in c]) for c in out]


def brute(rows, min_words):
    first, out = {}, []
    for _, r in sorted(enumerate(rows), key=lambda x: (x[1].doc_id is None, x[1].doc_id or 0, x[0])):
        found = clauses(r.text)
        pairs = list(zip(found, found[1:])) if len(found) != 1 else [(found[0], None)]
        run = []
        for one, two in [*pairs, (None, None)]:
            key = one and (tuple(one[2]), two and tuple(two[2]))
            if key and key in first:
                run.append((one, two, first[key]))
                continue
            if key:
                first[key] = r.doc_id, one[0]
            if run:
                last = run[-1][1] or run[-1][0]
                units = [a for a, _, _ in run] + ([run[-1][1]] if run[-1][1] else [])
                words = sum(len(u[2]) for u in units)
                if words >= min_words:
                    out.append((r.doc_id, run[0][0][0], last[1], words, len(units), *run[0][2]))
                run = []
    return sorted(out, key=repr)


def got(frame, min_words):
    rows = line_dedup.repeated_spans(frame, min_words=min_words).collect()
    return sorted([(r.doc_id, r.start, r.end, r.n_words, r.n_units, r.keep_id, r.keep_start) for r in rows], key=repr)


def test_spans(spark, rows, clashing, empty):
    a, b = "one two, three four five.", "ÉTÉ six;  seven eight nine\tten!"
    docs = spark.createDataFrame([(2, f"{b}\n{a}\n{a}"), (1, f"x\n{a}"), (1, f"{a.upper()}\nx"), (3, None), (None, b.replace("  ", " ")),
                                  (4, ""), (5, "only"), (6, "ONLY"), (7, "p q.\n\nr s"), (8, "p q. r\n \ns")], "doc_id long, text string").coalesce(1)
    for frame in (docs, clashing.coalesce(1)):
        for n in (1, 4, 30):
            assert got(frame, n) == brute(frame.collect(), n)
    assert line_dedup.repeated_spans(empty).count() == 0


def prose(rng, n):
    """Words that do not repeat by chance, in clauses, sentences and paragraphs."""
    out = []
    for k in range(n):
        w = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
        out.append(w + rng.choice(["", "", "", "", "", "", ",", ".", ";", ".\n", ""]))
    return out


def wrapped(words, width):
    return re.sub(r" ?\n ?", "\n", " ".join(w if (k + 1) % width else w + "\n" for k, w in enumerate(words)))


def test_planted_passages_are_found_and_others_stay(spark):
    """Independent of the units: passages of 50 to 120 words, cut in anywhere and wrapped anew, against clean texts."""
    rng = random.Random(4)
    passages = [prose(rng, rng.randrange(50, 121)) for _ in range(20)]
    docs, planted = [], {}
    for d in range(120):
        words = prose(rng, rng.randrange(40, 300))
        if d % 3 == 0:
            passage = passages[rng.randrange(20)]
            at = rng.randrange(len(words))
            words[at:at] = passage
            planted.setdefault(id(passage), []).append((d, len(passage)))
        docs.append((d, wrapped([w.strip("\n") for w in words], rng.choice([5, 11, 10_000]))))
    again = dict(x for found in planted.values() for x in found[1:])
    found = {}
    for r in line_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_words
    assert set(found) <= set(again)
    assert len(set(found) & set(again)) >= 0.9 * len(again)
    assert sum(min(found.get(d, 0), n) for d, n in again.items()) >= 0.7 * sum(again.values())


def test_unpunctuated_text_is_found(spark):
    rng = random.Random(8)
    passage = [w.strip(".,;\n") for w in prose(rng, 200)]
    docs = [(1, " ".join(passage)), (2, " ".join([w.strip(".,;\n") for w in prose(rng, 60)] + passage[30:180]))]
    (r,) = line_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert r.doc_id == 2 and r.n_words >= 100


def test_short_repeats_stay(spark):
    docs = spark.createDataFrame([(1, "And ornd."), (2, "And ornd."), (3, "and, so. on, and")], "doc_id long, text string")
    assert line_dedup.repeated_spans(docs).count() == 0


def test_removal(spark, clashing, empty):
    a = "One two three, four five six."
    docs = spark.createDataFrame([(1, f"{a}\nx"), (2, f"y.\n{a}\nz"), (3, a + " x"), (4, f"q.\n{a}"), (5, None)], "doc_id long, text string")
    out = line_dedup.remove_repeats(docs, min_words=4)
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{a}\nx", 2: "y.\nz", 3: "", 4: "q.", 5: None}
    assert line_dedup.repeated_spans(out, min_words=4).count() == 0
    assert line_dedup.remove_repeats(clashing).columns == clashing.columns
    assert line_dedup.remove_repeats(empty).count() == 0


def test_one_of_repeated_rows_keeps_its_passage(spark):
    line = "Some words, that are long enough to be a passage; with clauses, and an end."
    docs = spark.createDataFrame([(1, line), (1, line), (1, line + " More.")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.remove_repeats(docs, min_words=10).collect()) in (["", "", line + " More."], ["", "More.", line])

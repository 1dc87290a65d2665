"""License scans against plain loops over all blocks and templates."""

import random
import re

import pytest

from lodestar.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: chr(ord(m.group()) + 32), text or ""))


def brute(rows, notices=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    out = []
    for doc, text in rows:
        w = words(text)
        places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w))
                        if w[i:i + len(p.split())] == p.split())
        base, labels, score = {v for _, v in places}, set(), 0.0
        for i in range(0, len(w), licenses.BLOCK_WORDS // 2):
            block = set(w[i:i + licenses.BLOCK_WORDS])
            for label, notice in notices:
                tokens = set(words(notice))
                share = len(tokens & block) / len(tokens)
                if share >= threshold - 1e-9:
                    labels.add(label)
                    score = max(score, share)
        out.append((doc, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 9)))
    return sorted(out, key=str)


def got(df, **options):
    rows = licenses.scan(df, **options).select(*NAMES).collect()
    return sorted(((*r[:-1], round(r[-1], 9)) for r in rows), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    filler = [f"w{k}" for k in range(40)] + ["the", "of", "license", "version", "software", "cc", "été", "日本"]
    rows = []
    for k in range(60):
        parts = rng.choices(filler, k=rng.randrange(5, 400))
        for _ in range(rng.randrange(3)):
            notice = licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))][1].split()
            notice = [x for x in notice if rng.random() > rng.choice([0, .1, .3])]
            at = rng.randrange(len(parts))
            parts[at:at] = ["\n" if rng.random() < .1 else x for x in notice]
        rows.append((k, " ".join(parts)))
    rows += [(3, "MIT license, mit License! The MIT\nlicense"), (None, "cc by cc by"), (None, None), (90, ""), (91, " .,"),
             (92, "gnu general public gnu general public license"), (93, "Apache-License"), (94, "cc"), (95, "mit licenses"),
             (96, "x " * 50_000 + "Released under the MIT License." + " y" * 10_000), (96, "Released under the MIT License.")]
    return rows


def test_equals_all_pairs(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    for c in ("row", "blocks", "places", "token", "tokens", "size", "label", "r"):
        df = df.selectExpr("*", f"'clash' as {c}")
    assert got(df) == brute(texts)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_other_templates_and_thresholds(spark, texts, threshold):
    notices = [("a", "w1 w2 w3 w4 w5"), ("b", "w1 the the of"), ("c", "日本 été"), ("d", "cc")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(df, notices=notices, threshold=threshold) == brute(texts, notices, threshold)


def test_common_tokens_come_last(spark):
    df = spark.createDataFrame([(k, "the license" if k else "the mit") for k in range(9)], "doc_id long, text string")
    assert licenses.token_order(df, licenses.templates([("x", "the mit license rare")])) == ["rare", "mit", "license", "the"]


def test_templates_are_bounded():
    with pytest.raises(ValueError):
        licenses.templates([("x", "w " * 65)])
    with pytest.raises(ValueError):
        licenses.templates([("x", "...")])


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import collections
import random
import re

from lodestar.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def check(df):
    for r in q.judge(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_base(rows, clashing, empty):
    check(clashing)
    assert q.judge(empty).count() == 0
    assert set(rows.columns) <= set(q.judge(rows).columns)


def test_random_texts(spark):
    random.seed(8)
    texts = ["".join(random.choices(["a ", "b ", "a b c d e ", "\n", "x\n", "#", "\t", "z z "], k=random.randint(0, 80)))
             for _ in range(300)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_lines(spark):
    good = "The committee met on Tuesday and agreed on the budget for next year."
    other = "Members asked for a second reading of the plan before the summer break."
    text = "\n".join([good, "home | about | contact | login", "Click here to subscribe to our newsletter.", "short fragment", other])
    r = q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert r.cleaned_text == good + "\n" + other and r.kept
    lost = "a b c d e f g h i j k l m n\no p q r s t u v"
    r = q.judge(spark.createDataFrame([(1, lost)], "doc_id long, text string")).head()
    assert not r.base_failed and not r.kept and r.cleaned_text == ""


def wrap(text, width):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + 1 + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_prose_stays_however_it_is_wrapped(spark):
    rng = random.Random(3)
    names = ["meeting", "council", "river", "agreed", "and", "the", "of", "budget", "north", "bridges", "before", "summer"]
    prose = " ".join(" ".join(rng.choices(names, k=rng.randrange(8, 25))).capitalize() + "." for _ in range(25))
    texts = [prose, wrap(prose, 80), wrap(prose, 45), prose + " Click here to read more.", wrap(prose + " Click here to read more.", 70)]
    for r in q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.kept_chars >= (r.word_chars if r.doc_id < 4 else 0.95 * r.word_chars) and (r.kept or r.base_failed), r.doc_id


def test_fragments_and_menus_beside_wrapped_prose_go(spark):
    prose = wrap("The council met by the river on Tuesday, and after a long debate agreed on the new bridges in the north.", 40)
    bad = ["Home | About us | Contact the council | Search", "short fragment", "Click here to subscribe to our newsletter",
           "a heading that is wide enough to go on but does not"]
    text = prose + "\n" + "\n\n".join(bad) + "\n\n" + prose
    r = q.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert [x for x in r.cleaned_text.split("\n") if x] == [*prose.split("\n"), *prose.split("\n")]


def test_many_wrapped_lines(spark):
    text = "\n".join(f"line number {k} of a very long block of wrapped text" for k in range(30_000)) + "."
    r = q.judge(spark.createDataFrame([(1, text), (2, text[:-1])], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].kept_chars == r[0].word_chars and r[1].kept_chars == 0


def test_clean(clashing, empty):
    out = q.clean(clashing)
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 3 not in ids and 4 not in ids
    assert q.clean(empty).count() == 0


def test_native_plan(rows):
    plan = q.judge(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

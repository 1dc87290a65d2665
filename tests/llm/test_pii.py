import random
import re

from lodestar.llm import pii, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(t):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def check(df):
    for r in pii.find(df).join(df.select("doc_id", "text"), "doc_id").collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r.base] == brute(r.text), r.text[:80]
        for s in [*r.base, *r.added]:
            assert r.text[s["start"]:s["end"]] == s["value"]


def test_awkward_matches(spark):
    random.seed(9)
    texts = ["a@b.c_d@e.f a@b.c@d.e x..@y-.z", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4 1.2.3.4.5",
             "4111 1111 1111 1111 4111-1111-1111-1111 0 0", "+1 (017) 555-7713 +49 30 1234567 ++1 22222222",
             "é\U0001F600" * 5 + "a@b.cc " + "9" * 20_000, "1 " * 9000, "a@" + "b." * 9000 + "c", "a" * 30_000 + "@b.c", ""]
    texts += ["".join(random.choices([*"12.5@ab+-( )é_%", "4111111111111111", "@x.y", "1.2.3.4"], k=random.randint(1, 40)))
              for _ in range(300)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_many_matches(spark):
    check(spark.createDataFrame([(1, "a@b.c é " * 1500)], "doc_id long, text string"))


def test_bootstrapping(spark):
    """Seeds after "token =" make it a pattern that also gives strings of another form; random contexts give none."""
    random.seed(3)
    docs = [(i, f"some words here token = \"{random.getrandbits(160):040x}\" and the end.") for i in range(12)]
    docs += [(100, "again a TOKEN = AB12-CD34-EF56 in capitals."), (101, "the year 20240101 is no secret to anyone.")]
    docs += [(200 + i, f"the and of w{i} x{i}@mail.com then more.") for i in range(5)]
    got = {r.doc_id: [s["value"] for s in r.added] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[100] == ["AB12-CD34-EF56"] and got[101] == []
    assert all(len(got[i]) == 1 for i in range(12)) and not any(got[200 + i] for i in range(5))


def test_patterns_count_in_every_text(spark):
    """A context that ids fill in the few texts with digits, but that mostly stands in prose, is no pattern."""
    random.seed(5)
    docs = [(i, f"we saw the value {random.getrandbits(160):040x} there") for i in range(6)]
    docs += [(50, "again the value AB12-CD34-EF56 was seen")]
    prose = [(100 + i, "nobody doubts the value of a good book") for i in range(60)]
    found = lambda d: {r.doc_id for r in pii.find(spark.createDataFrame(d, "doc_id long, text string")).collect() if r.added}
    assert found(docs) == {*range(6), 50} and not found(docs + prose)


def test_scores_against_plain_loops(spark):
    edges = [("p", "s1", 3, True), ("p", "s2", 2, True), ("p", "s3", 1, True), ("p", "x", 2, False), ("q", "x", 4, False),
             ("q", "s1", 1, True), ("q", "s2", 1, True), ("q", "s3", 1, True), ("r", "x", 1, False), ("r", "y", 1, False)]
    totals = {"p": 10, "q": 9, "r": 50}
    score = {i: float(s) for _, i, _, s in edges}
    for k in range(3):
        ps = {}
        for p in totals:
            mine = [e for e in edges if e[0] == p]
            ps[p] = min(1.0, sum(e[2] * score[e[1]] for e in mine) / totals[p]) if sum(score[e[1]] for e in mine) >= 3 else 0.0
        for i in ("x", "y"):
            miss = 1.0
            for e in edges:
                if e[1] == i:
                    miss *= 1 - min(ps[e[0]], 0.999999)
            score[i] = 1 - miss
    got = pii.score_patterns(spark.createDataFrame(edges, "pattern string, instance string, n long, seed boolean"),
                             spark.createDataFrame(list(totals.items()), "pattern string, n_all long")).collect()
    assert {r.pattern: round(r.score, 9) for r in got} == {p: round(v, 9) for p, v in ps.items()}


def test_awkward_rows(rows, clashing, empty):
    got = pii.find(clashing).collect()
    assert len(got) == rows.count() and all(isinstance(r.base, list) for r in got)
    assert pii.find(empty).count() == 0


def test_native_plan(rows):
    plan = pii.find(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.c or 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_pii_contexts(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:5:10,ip:14:21" and (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[2].spans == "" and got[2].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_context_before_a_long_word_and_long_gaps(spark):
    """The two words before the word that holds a span, however far off they are."""
    path = "p/" * 110
    texts = {1: f"the access https://x.org/{path}?token=AB12345", 2: "the access" + " " * 300 + "AB12345", 3: "x the access AB12345",
             4: "access " + "y" * 200 + "=AB12345", 5: "AB12345", 6: "z " * 100 + "é" * 130 + " key " + "q" * 130 + "=AB12345"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: [s["pattern"] for s in r["found"] if s["value"] == "AB12345"] for r in pii._occurrences(rows, "doc_id", "text").collect()}
    assert got == {1: ["the access"], 2: ["the access"], 3: ["the access"], 4: [None], 5: [None], 6: [None]}


def test_recall_of_held_out_secrets(spark):
    """Secrets in induced contexts whose own strings are no seeds: all are found, and ordinary numbers are not."""
    random.seed(5)
    token = lambda: "".join(random.choices("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", k=10)) + "7313"
    hexes = lambda: "".join(random.choices("0123456789abcdef", k=40))
    rows, held = [], set()
    for k in range(300):
        if k % 5 == 0:                      # by number: the held-out fifth carries tokens, the others hexadecimal seeds
            held.add(k)
            rows.append((k, f"Some words here. My access key {token()} must stay private."))
        else:
            rows.append((k, f"Other words there. My access key {hexes()} must stay private."))
    rows += [(1000 + k, f"In the year {1000000 + k} there were {20000 + k} people.") for k in range(300)]
    found = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.added}
    assert len(found & held) == len(held) and not any(d >= 1000 for d in found)

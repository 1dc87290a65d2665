import itertools
import math
import random
import re

from lodestar.llm import url_filter as u


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_segmentation_is_the_cheapest_cut():
    random.seed(1)
    counts = {"a": 5, "ab": 9, "ba": 4, "abb": 2, "b": 1, "aab": 7}
    cutter = u.Segmenter(counts)

    def cost(cut):
        return sum(cutter.cost.get(w, cutter.unknown + cutter.per_char * len(w)) for w in cut)

    for _ in range(200):
        name = "".join(random.choices("abc", k=random.randint(1, 9)))
        cuts = [[name[i:j] for i, j in zip((0, *c), (*c, len(name)))] for k in range(len(name))
                for c in itertools.combinations(range(1, len(name)), k)]
        assert math.isclose(cost(cutter.split(name)), min(map(cost, cuts)))
    assert cutter.split("") == []


def _pages(spark):
    random.seed(2)
    html = "<html><script>var zz=1</script><p>free bets and cheap pills for the casino</p></html>"
    hosts = ["freebets.net", "a.example.net", "news.org", "Shop.Example.COM", "cheappills.com", "org", "xnet"]
    paths = ["/en/1", "/fr/2.html", "/de/3?q=/en/", "", "/", "#x", "/x/freepills"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths] + [None, "", "no scheme", "a://", "x://y://z/"]
    return spark.createDataFrame([(i, x, html if i % 3 else None) for i, x in enumerate(urls)], "page_id long, url string, html string")


def test_judgement_against_plain_loops(spark):
    pages = _pages(spark)
    words, odds, prior = model = u.fit(pages)
    assert words["bets"] and "zz" not in words
    cutter = u.Segmenter(words)
    assert cutter.split("freebets") == ["free", "bets"]
    rows = pages.collect()
    tokens = {r.page_id: cutter.tokens(*brute_parts(r.url)) for r in rows}
    labels = {r.page_id: brute_rule(*brute_parts(r.url))[1] for r in rows}
    count = {v: {} for v in ("block", "allow")}
    for i, v in labels.items():
        for t in tokens[i] if v else ():
            count[v][t] = count[v].get(t, 0) + 1
    vocabulary = set(count["block"]) | set(count["allow"])
    n = {v: sum(c.values()) + len(vocabulary) for v, c in count.items()}
    want = {t: math.log((count["block"].get(t, 0) + 1) / n["block"]) - math.log((count["allow"].get(t, 0) + 1) / n["allow"])
            for t in vocabulary}
    assert odds.keys() == want.keys() and all(math.isclose(odds[t], want[t], abs_tol=1e-12) for t in want)
    docs = list(labels.values())
    assert math.isclose(prior, math.log((docs.count("block") + 1) / (docs.count("allow") + 1)))
    got = {r.page_id: r for r in u.judge(pages, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        host, path = brute_parts(r.url)
        rule, verdict = brute_rule(host, path)
        score = prior + sum(want.get(t, 0.0) for t in tokens[r.page_id]) if tokens[r.page_id] else 0.0
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == (verdict or ("block" if score > 1e-9 else "allow"))


def test_awkward_pages(spark):
    pages = _pages(spark)
    nothing = pages.limit(0)
    assert u.judge(nothing, u.fit(nothing)).count() == 0
    unlabelled = spark.createDataFrame([(1, "http://a.com/x", None), (1, "http://a.com/x", "<p>x</p>"), (None, "h" * 50_000 + "://q", "")],
                                       "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as verdict")
    got = u.judge(unlabelled, u.fit(unlabelled)).collect()
    assert [r.verdict for r in got] == ["allow"] * 3


def test_vocabulary_bound(spark):
    counted = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 1), ("e", 1)], "w string, n long")
    kept = lambda bound: sorted(r.w for r in u._most_frequent(counted, bound))
    assert kept(9) == ["a", "b", "c", "d", "e"] and kept(4) == ["a", "b", "c"] and kept(2) == ["a", "b"] and kept(1) == []


def test_no_word_or_token_is_left_out(spark):
    """However few words and names are broadcast, model and verdicts are those of the whole counts."""
    pages = _pages(spark)
    words, odds, _ = whole = u.fit(pages)
    want = {r.page_id: (r.verdict, r.p_block) for r in u.judge(pages, whole).collect()}
    for bound in (3, 0):
        few = u.fit(pages, max_words=bound, max_tokens=bound)
        assert dict(few[0]) == dict(words) and dict(few[1]) == dict(odds)
        assert {r.page_id: (r.verdict, r.p_block) for r in u.judge(pages, few).collect()} == want


def test_long_words_are_words(spark):
    """Words of any length are counted, and a host of two long ones is cut between them."""
    long_, other = "donaudampfschifffahrtsgesellschaft", "rindfleischetikettierung"
    rows = [(k, f"http://x{k}.org/", f"<p>{long_} {other} kurz</p>") for k in range(5)]
    pages = spark.createDataFrame([*rows, (9, f"http://{long_}{other}.com/", "")], "page_id long, url string, html string")
    words, *_ = u.fit(pages)
    assert dict(words)[long_] == 5 and dict(words)["kurz"] == 5
    key = spark.createDataFrame([("h:" + long_ + other,)], "key string")
    for bound in (50_000, 0):
        (row,) = u._parts(u.pinned(key), u.Table(words.rows, bound)).collect()
        assert [t[2:] for t in row.tokens] == [long_, other]

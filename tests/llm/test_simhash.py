import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash
from lodestar.llm.components import components


def brute_fp(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    best = list(range(len(fps)))

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                best[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_fingerprints(rows):
    for r in rows.filter("length(text) < 1000 or text is null").collect():
        assert simhash.fingerprint(r.text) % (1 << 64) == brute_fp(r.text)
    long_text = "Ab c " * 9000
    assert simhash.fingerprint(long_text) % (1 << 64) == brute_fp(long_text)


def _planted(n, bits, seed):
    """Fingerprints around a few centres, many within and many just beyond three bits."""
    random.seed(seed)
    centres = [random.getrandbits(64) for _ in range(4)] + [0]
    out = []
    for _ in range(n):
        f = random.choice(centres)
        for b in random.sample(range(64), random.randint(0, bits)):
            f ^= 1 << b
        out.append(f - (1 << 64) if f >> 63 else f)
    return sorted(set(out))


def test_links_lose_nothing(spark):
    for hot in (1, 4, 1000):
        fps = _planted(400, 5, hot)
        got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot_bucket=hot).collect()}
        u = np.array(fps, dtype=np.int64).view(np.uint64)
        want = {(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= 3) + i + 1}
        assert got == want


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)] + [(5, 5), (None, 3)], "a long, b long")
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_groups(rows, clashing, empty):
    data = rows.collect()
    got = simhash.near_duplicates(clashing).collect()
    fps = [brute_fp(r.text) if len(r.text or "") < 1000 else simhash.fingerprint(r.text) % (1 << 64) for r in data]
    want = brute_components([r.doc_id for r in data], fps)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == sorted(
        [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(data, fps, want)], key=repr)
    assert simhash.near_duplicates(empty).count() == 0


def test_drop(rows, clashing, empty):
    out = simhash.drop_near_duplicates(clashing)
    assert out.columns == clashing.columns
    kept = [r.doc_id for r in out.collect()]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows.filter("doc_id is not null")).collect()}
    assert sorted(k for k in kept if k is not None) == sorted({c for c in groups.values()})
    assert kept.count(None) == 1
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_unrelated_texts_of_one_id_stay(spark):
    a, b, c = ("one two three four five six seven", "red green blue white black grey pink", "north east south west up down out")
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (2, a), (3, b), (4, b), (5, c), (5, c)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()) == [(1, a), (1, b), (2, c)]
    assert simhash.drop_near_duplicates(docs.limit(2)).count() == 2


def test_same_hash_as_the_session(spark):
    """The fingerprint's hash is the public XXH64 with seed 42."""
    text = "été one two"
    h = spark.range(1).select(F.xxhash64(F.lit(text))).head()[0]
    assert h % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)

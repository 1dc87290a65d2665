"""op2 and op6 as whole queries against plain loops: dictionaries for models, one gram and one weight at a time."""

import math
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lodestar.llm import queries

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def _table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def _softmax(logits):
    top = max(logits)
    e = [math.exp(x - top) for x in logits]
    return [x / sum(e) for x in e]


class PlainFtrl:
    """Follow-the-regularised-leader, one coordinate at a time; the feature ``"bias"`` is always 1."""

    def __init__(self, classes, alpha, l1, l2, beta=1.0):
        self.classes, self.alpha, self.l1, self.l2, self.beta = classes, alpha, l1, l2, beta
        self.z, self.n = {}, {}

    def weight(self, feature, c):
        z, n = self.z.get((feature, c), 0.0), self.n.get((feature, c), 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def logits(self, x):
        return [self.weight("bias", c) + sum(v * self.weight(f, c) for f, v in x.items()) for c in range(self.classes)]

    def learn(self, rows, epochs):
        for _ in range(epochs):
            for x, label in rows:
                full = {**x, "bias": 1.0}
                p = _softmax(self.logits(x))
                for f, v in full.items():
                    for c in range(self.classes):
                        g = v * (p[c] - (c == label))
                        w, n = self.weight(f, c), self.n.get((f, c), 0.0)
                        self.z[f, c] = self.z.get((f, c), 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * w
                        self.n[f, c] = n + g * g
        return self


# ---------------------------------------------------------------- op6 ----
def _gram_feature(gram):
    h = len(gram)
    for ch in gram:
        h = (h ^ ord(ch)) * 0x9E3779B97F4A7C15 & M64
        h ^= h >> 29
    return (h * 0x9E3779B97F4A7C15 & M64) >> 48


def _grams(text):
    letters = "".join(ch if ch.isalpha() else " " for ch in text.lower())
    clean = " " + " ".join(letters.split()) + " "
    return Counter(_gram_feature(clean[a:a + n]) for n in (1, 2, 3) for a in range(len(clean) - n + 1))


def _best_temperature(scores, labels):
    if not labels:
        return 1.0

    def loss(t):
        return -sum(math.log(max(_softmax([x / t for x in s])[y], 1e-300)) for s, y in zip(scores, labels))

    grid = [math.exp(math.log(0.05) + k * math.log(400.0) / 400) for k in range(401)]
    at = min(range(401), key=lambda k: loss(grid[k]))
    low, high = grid[max(at - 1, 0)], grid[min(at + 1, 400)]
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return (low + high) / 2


def test_language_query(spark):
    docs = _table("documents")
    out = {d["doc_id"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2}
    learned = [d for d in docs if d["doc_id"] not in out and d["lang"] is not None]
    assert all(any(map(str.isalpha, d["text"])) for d in docs)          # nothing here is undetermined
    languages = sorted({d["lang"] for d in learned})
    frequency = Counter(f for d in learned for f in _grams(d["text"]))

    def vector(text):
        raw = {f: (1 + math.log(n)) * (math.log((1 + len(learned)) / (1 + frequency[f])) + 1) for f, n in _grams(text).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {f: v / norm for f, v in raw.items()}

    rows = sorted((zlib.crc32(f"6:{d['doc_id']}".encode()), d["lang"], vector(d["text"])) for d in learned)
    fitting, back, seen = [], [], set()
    for key, lang, x in rows:
        (back if key % 5 == 0 and lang in seen else fitting).append((x, languages.index(lang)))
        seen.add(lang)
    model = PlainFtrl(len(languages), alpha=1.0, l1=0.02, l2=0.1).learn(fitting, epochs=3)
    t = _best_temperature([model.logits(x) for x, _ in back], [y for _, y in back])

    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        p = _softmax([v / t for v in model.logits(vector(d["text"]))])
        r = got[d["doc_id"]]
        assert r.held_out == (d["doc_id"] in out)
        assert r.lang_pred == languages[p.index(max(p))] and r.score == pytest.approx(max(p), abs=1e-5)


# ---------------------------------------------------------------- op2 ----
def _words(text):
    letters = "".join(ch if ch.isalpha() else " " for ch in (text or "").lower())
    parts = set()
    for w in letters.split():
        parts |= {w + " "} | {w[:k] for k in (3, 5, 7) if len(w) > k}
    return {zlib.crc32(p.encode()) % (1 << 18): 1.0 for p in parts}


def test_toxicity_query(spark):
    docs, labels = _table("documents"), {r["doc_id"]: r for r in _table("labels")}
    rows = sorted((zlib.crc32(f"2:{d['doc_id']}".encode()), d["doc_id"], _words(d["text"])) for d in docs if d["doc_id"] in labels)

    def fitted(examples):
        return PlainFtrl(2, alpha=0.3, l1=8.0, l2=0.1).learn(examples, epochs=4)

    def chance(model, x):
        return _softmax(model.logits(x))[1]

    quality = fitted([(x, labels[i]["quality"]) for _, i, x in rows])
    out_of_fold = {}
    for fold in range(5):
        model = fitted([(x, labels[i]["quality"]) for k, i, x in rows if k % 5 != fold])
        out_of_fold |= {i: chance(model, x) for k, i, x in rows if k % 5 == fold}
    toxic = fitted([({**x, "quality": out_of_fold[i]}, labels[i]["toxic"]) for _, i, x in rows])

    got = {r.doc_id: r for r in queries.op2_toxicity_chain(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        x = _words(d["text"])
        p = chance(quality, x)
        q = chance(toxic, {**x, "quality": p})
        r = got[d["doc_id"]]
        assert r.p_quality == pytest.approx(p, abs=1e-6) and r.p_toxic == pytest.approx(q, abs=1e-6)
        assert r.toxic == (q > 0.5) or q == pytest.approx(0.5, abs=1e-6)

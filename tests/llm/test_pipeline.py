"""The stages against plain Python forms of their decisions, each on its own input."""

import hashlib
import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import mixing, quality_rules, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _documents(spark):
    random.seed(11)
    vocabulary = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(240):
        text = "\n".join(" ".join(random.choices(vocabulary, k=random.randint(8, 20))) + "." for _ in range(random.randint(1, 9)))
        rows.append([i, text, random.choice(["en", "de"]), random.choice(["s1", "s2", "s2", "s3"])])
    for i in range(240, 300):
        r = list(random.choice(rows[:200]))
        r[0] = i
        kind = i % 4
        if kind == 0:
            r[1] = r[1].replace(" ", "  ")
        elif kind == 1:
            r[1] += " extra."
        elif kind == 2:
            r[1] = "home | about | login\n" + r[1] + "\nAll rights reserved."
        else:
            r[1] = "spam " * 60
        rows.append(r)
    rows += [[300, None, None, None], [301, "", "en", "s1"], rows[5]]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _components(rows):
    fps = [simhash.fingerprint(r.text) % (1 << 64) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    return set(low.values())


def test_stages(spark, tmp_path):
    docs = _documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"stage{k}")))
    assert all(d.columns == docs.columns for d in seen[1:-1])
    verdicts = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    got = {r.doc_id: r for r in seen[1].collect()}
    assert set(got) == {i for i, r in verdicts.items() if r.kept}
    assert all(r.text == verdicts[i].cleaned_text and r.n_chars == len(r.text) for i, r in got.items())
    assert set(range(240)) - {i for i, r in verdicts.items() if r.base_failed} <= set(got)        # clean documents stay
    rows = seen[1].collect()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append(r)
    best = sorted(min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values())
    assert sorted(r.doc_id for r in seen[2].collect()) == best
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted(_components(seen[2].collect()))
    rows = seen[3].collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    size = {r.doc_id: len(WORD.findall(r.text)) for r in rows}
    whole = [sum(size[r.doc_id] for r in rows if r.source == s) for s in sources]
    target = dict(zip(sources, mixing.target_sizes(whole, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])))
    want = {}
    for s, total in zip(sources, whole):
        full, rest = divmod(round(target[s]), total)
        at = 0
        for r in sorted((r for r in rows if r.source == s),
                        key=lambda r: int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:15], 16)):
            want[r.doc_id] = full + (at + size[r.doc_id] / 2 < rest)
            at += size[r.doc_id]
    mixed = seen[4].collect()
    assert {i: n for i, n in want.items() if n} == {i: sum(r.doc_id == i for r in mixed) for i in {r.doc_id for r in mixed}}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed}
    coded = seen[5].collect()
    assert len(coded) == len(mixed)
    for r in coded:
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_and_empty_input(spark, tmp_path):
    _documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

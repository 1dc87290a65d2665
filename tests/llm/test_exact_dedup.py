import hashlib
import re

from lodestar.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r)
    out = []
    for members in groups.values():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        out += [(r.doc_id, best.doc_id, len(members), hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in members]
    return sorted(out, key=repr)


def test_groups(rows, clashing):
    got = exact_dedup.duplicate_groups(clashing, hash_all=True).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(rows.collect())
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})       # repeated rows leave one


def test_a_tiny_bitmap_changes_nothing(rows):
    wide = exact_dedup.duplicate_groups(rows, hash_all=True).collect()
    tight = exact_dedup.duplicate_groups(rows, hash_all=True, filter_bits=15, prefix_chars=1).collect()
    assert sorted(map(repr, wide)) == sorted(map(repr, tight))


def test_refined_rows_are_not_hashed(spark):
    df = spark.createDataFrame([(1, "one"), (2, "seven"), (3, "sev en"), (4, "eight")], "doc_id long, text string")
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.duplicate_groups(df).collect()}
    assert got[1] is None and got[4] is None and got[2] == got[3] is not None


def test_drop(rows, clashing, empty):
    got = exact_dedup.drop_duplicates(clashing)
    assert got.columns == clashing.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(r.text) for r in rows.collect()})
    assert exact_dedup.drop_duplicates(empty).count() == 0
    assert exact_dedup.duplicate_groups(empty).count() == 0


def test_native_plan(rows):
    plan = exact_dedup.duplicate_groups(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

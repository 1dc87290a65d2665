"""DuckDB SQL oracles, one per registered query key (same column names).

Tables are the pre-registered views of the test parquet files. Vectors are
cast to DOUBLE[] before any arithmetic, doubles are rounded to 6 places.
"""

from __future__ import annotations

from lodestar import config

TINY_ROWS = 150           # the tiny corpus of the registered query: fewer rows than any test table


def positive_zero_rounding(sql: str) -> str:
    """Rewrite every ``round(...)`` as ``(round(...) + 0.0)``.

    DuckDB keeps the sign of a value that rounds to zero (-0.0) while Spark's
    decimal rounding gives 0.0; adding 0.0 turns -0.0 into 0.0.
    """
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = positive_zero_rounding(sql[j + len(key):k - 1])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k


def cos(a: str, b: str) -> str:
    return (f"(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * "
            f"sqrt(list_dot_product({b}, {b})), 0))")


NEG_INF = "'-inf'::DOUBLE"

TOWERS = """t0 AS (
  SELECT vec_id // 2 AS row_id,
         CAST(first(embedding) FILTER (WHERE vec_id % 2 = 0) AS DOUBLE[]) AS qv,
         CAST(first(embedding) FILTER (WHERE vec_id % 2 = 1) AS DOUBLE[]) AS cv,
         first(label) FILTER (WHERE vec_id % 2 = 0) AS ql,
         first(label) FILTER (WHERE vec_id % 2 = 1) AS cl
  FROM embeddings GROUP BY vec_id // 2),
t AS (SELECT * FROM t0 WHERE qv IS NOT NULL AND cv IS NOT NULL)"""


def scores_cte(pool: int) -> str:
    return f"""{TOWERS},
p AS (SELECT row_id, row_id // {pool} AS batch_id, qv, cv FROM t),
{RANKS}"""


RANKS = f"""s AS (SELECT a.batch_id, a.row_id AS qid, b.row_id AS cid, {cos('a.qv', 'b.cv')} AS s
      FROM p a JOIN p b ON a.batch_id = b.batch_id),
tg AS (SELECT qid, s AS st FROM s WHERE qid = cid),
r AS (SELECT s.batch_id, s.qid AS row_id, max(tg.st) AS target_score,
             coalesce(max(greatest(s.s, 0.0)) FILTER (WHERE s.cid <> s.qid), 0.0) AS hardest_negative,
             1 + count(*) FILTER (WHERE s.cid <> s.qid AND (
                   coalesce(s.s, {NEG_INF}) > coalesce(tg.st, {NEG_INF})
                   OR (coalesce(s.s, {NEG_INF}) = coalesce(tg.st, {NEG_INF}) AND s.cid < s.qid))) AS rank,
             count(*) AS pool_size
      FROM s JOIN tg ON s.qid = tg.qid GROUP BY s.batch_id, s.qid)"""


VALID = scores_cte(config.BATCH_SIZE)
TEST = scores_cte(config.MRR_POOL)

KNN = f"""{TOWERS},
s AS (SELECT q.row_id AS query_id, c.row_id AS code_id, {cos('q.qv', 'c.cv')} AS score FROM t q CROSS JOIN t c),
k AS (SELECT query_id, code_id, score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, code_id) AS BIGINT)
               AS position
      FROM s QUALIFY position <= {config.N_RESULTS}),
pred AS (SELECT lower('Query ' || query_id) AS query, 'vec/' || code_id AS url, position, query_id FROM k)"""

ANN = f"""{KNN},
ann_raw AS (
  SELECT 'Python' AS Language, 'Query ' || q.row_id AS Query, 'vec/' || c.row_id AS GitHubUrl,
         CASE WHEN abs(q.ql - c.cl) = 0 THEN 3 WHEN abs(q.ql - c.cl) = 1 THEN 1 ELSE 0 END AS g
  FROM t q JOIN t c ON c.row_id BETWEEN q.row_id - 1 AND q.row_id + 1),
raw AS (SELECT Language, Query, GitHubUrl, CAST(g AS DOUBLE) AS Relevance FROM ann_raw
        UNION ALL
        SELECT 'python' AS Language, Query, GitHubUrl, CAST(greatest(g - 1, 0) AS DOUBLE) AS Relevance FROM ann_raw
        UNION ALL
        SELECT 'Java' AS Language, Query, GitHubUrl, 2.0::DOUBLE AS Relevance FROM ann_raw WHERE g = 3
        UNION ALL
        SELECT Language, 'Unsearched ' || Query AS Query, GitHubUrl, 1.0::DOUBLE AS Relevance FROM ann_raw WHERE g = 3),
ann AS (SELECT lower(regexp_replace(regexp_replace(Query, '^\\s+', ''), '\\s+$', '')) AS query,
               GitHubUrl AS url, avg(Relevance) AS relevance
        FROM raw WHERE lower(Language) = 'python'
          AND Query IS NOT NULL AND GitHubUrl IS NOT NULL AND Relevance IS NOT NULL
        GROUP BY 1, 2),
j AS (SELECT p.query, p.url, p.position, a.relevance
      FROM pred p LEFT JOIN ann a ON p.query = a.query AND p.url = a.url
      WHERE p.query IN (SELECT query FROM ann)),
w AS (SELECT *, CAST(count(relevance) OVER (PARTITION BY query ORDER BY position
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rank_within FROM j),
ir AS (SELECT query, url, relevance,
              CAST(row_number() OVER (PARTITION BY query ORDER BY relevance DESC, url) AS BIGINT) AS ideal_rank
       FROM ann)"""

F1 = """c AS (SELECT conv_id, turn, role, text,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext
      FROM conversations),
f1 AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id, conv_id, turn,
              CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url, text AS query, ntext AS code
       FROM c WHERE role = 'user' AND nrole = 'assistant')"""

def _feistel(x: str) -> str:
    """One pass of the keyed permutation over ``left * b + right``, epoch 0."""
    def value(r: int, side: str) -> str:
        return f"('0x' || substr(md5('{config.SEED}:0:' || split || ':{r}:' || {side}), 1, 8))::BIGINT"

    left, right = f"(({x}) // b)", f"(({x}) % b)"
    for r in range(4):
        if r % 2 == 0:
            left = f"(({left} + {value(r, right)}) % a)"
        else:
            right = f"(({right} + {value(r, left)}) % b)"
    return f"({left} * b + {right})"


SPLIT = f"""{F1},
sp0 AS (SELECT row_id, row_number() OVER (ORDER BY md5('{config.SEED}:' || row_id), row_id) - 1 AS hpos FROM f1),
sz0 AS (SELECT count(*) AS n, CAST(floor(0.1::DOUBLE * count(*)) AS BIGINT) AS nv,
               CAST(floor(0.1::DOUBLE * count(*)) AS BIGINT) AS nt FROM f1),
sz AS (SELECT n - nv - nt AS ntr, nv, nt FROM sz0),
sp AS (SELECT row_id,
              CASE WHEN hpos < ntr THEN 'train' WHEN hpos < ntr + nv THEN 'valid' ELSE 'test' END AS split,
              hpos - CASE WHEN hpos < ntr THEN 0 WHEN hpos < ntr + nv THEN ntr ELSE ntr + nv END AS split_pos
       FROM sp0, sz),
sn AS (SELECT split, count(*) AS n, greatest(CAST(ceil(sqrt(count(*))) AS BIGINT), 1) AS a FROM sp GROUP BY split),
sb AS (SELECT *, greatest(CAST(ceil(n / a::DOUBLE) AS BIGINT), 1) AS b FROM sn),
f1w AS (SELECT row_id, split, split_pos, n, a, b, {_feistel('split_pos')} AS y FROM sp JOIN sb USING (split)),
f2w AS (SELECT * REPLACE (CASE WHEN y < n THEN y ELSE {_feistel('y')} END AS y) FROM f1w),
f3w AS (SELECT * REPLACE (CASE WHEN y < n THEN y ELSE {_feistel('y')} END AS y) FROM f2w),
f4w AS (SELECT * REPLACE (CASE WHEN y < n THEN y ELSE {_feistel('y')} END AS y) FROM f3w),
f5w AS (SELECT * REPLACE (CASE WHEN y < n THEN y ELSE {_feistel('y')} END AS y) FROM f4w),
sh AS (SELECT row_id, split, split_pos, CAST(CASE WHEN y < n THEN y END AS BIGINT) AS shuffle_pos FROM f5w)"""


ORACLE = {
    "pair_scores": f"""WITH {VALID}
SELECT row_id, batch_id, round(target_score, 6) AS target_score,
       round(hardest_negative, 6) AS hardest_negative, pool_size FROM r""",
    "hardest_negative": f"""WITH {VALID}
SELECT batch_id, row_id, round(hardest_negative, 6) AS hardest_negative FROM r""",
    "pair_loss": f"""WITH {VALID}
SELECT batch_id, round(avg(1 - target_score + hardest_negative), 6) AS loss, count(*) AS n_queries
FROM r GROUP BY batch_id""",
    "epoch_mean": f"""WITH {VALID},
l AS (SELECT batch_id, avg(1 - target_score + hardest_negative) AS loss, count(*) AS n_queries
      FROM r GROUP BY batch_id)
SELECT round(sum(loss * n_queries) / sum(n_queries), 6) AS loss, CAST(sum(n_queries) AS BIGINT) AS n_queries
FROM l""",
    "mrr": f"""WITH {VALID}
SELECT batch_id, round(avg(1.0 / rank), 6) AS mrr, count(*) AS n_queries FROM r GROUP BY batch_id""",
    "mrr_test_pool": f"""WITH {TEST}
SELECT round(avg(1.0 / rank), 6) AS mrr, count(*) AS n_queries FROM r""",
    "query_group_ids": f"""WITH {VALID}
SELECT batch_id, row_id, row_id AS query_group, rank FROM r""",
    "knn_exact": f"""WITH {KNN}
SELECT query_id, code_id, position, round(score, 6) AS score FROM k""",
    "knn_cells": f"""WITH {KNN}
SELECT query_id, code_id, position, round(score, 6) AS score FROM k""",
    "topk_results": f"""WITH {KNN}
SELECT query, url, position FROM pred""",
    "take_by_position": f"""WITH {KNN}
SELECT query_id, position, url FROM pred""",
    "mean_relevance": f"""WITH {ANN}
SELECT query, url, round(relevance, 6) AS relevance FROM ann""",
    "filter_code_lang": f"""WITH {ANN}
SELECT Language, Query, GitHubUrl, round(Relevance, 6) AS Relevance FROM raw WHERE lower(Language) = 'python'""",
    "relevance_map": f"""WITH {ANN}
SELECT p.query, p.url, p.position, round(coalesce(a.relevance, 0.0), 6) AS relevance
FROM pred p LEFT JOIN ann a ON p.query = a.query AND p.url = a.url""",
    "annotated_predictions": f"""WITH {ANN}
SELECT query, url, position, round(relevance, 6) AS relevance FROM j""",
    "queries_without_predictions": f"""WITH {ANN}
SELECT DISTINCT query FROM ann WHERE query NOT IN (SELECT query FROM pred)""",
    "dcg_rank": f"""WITH {ANN}
SELECT query, url, position, round(relevance, 6) AS relevance, rank_within, CAST(position AS BIGINT) AS rank_all
FROM w WHERE relevance IS NOT NULL""",
    "ideal_rank": f"""WITH {ANN}
SELECT query, url, round(relevance, 6) AS relevance, ideal_rank FROM ir""",
    "ndcg": f"""WITH {ANN},
idcg AS (SELECT query, sum((pow(2, relevance) - 1) / log2(ideal_rank + 1)) AS idcg FROM ir GROUP BY query),
dw AS (SELECT query, sum((pow(2, relevance) - 1) / log2(rank_within + 1)) AS dcg
       FROM w WHERE relevance IS NOT NULL GROUP BY query),
da AS (SELECT query, sum((pow(2, relevance) - 1) / log2(position + 1)) AS dcg
       FROM w WHERE relevance IS NOT NULL GROUP BY query)
SELECT round(avg(coalesce(dw.dcg, 0) / i.idcg), 6) AS ndcg_within,
       round(avg(coalesce(da.dcg, 0) / i.idcg), 6) AS ndcg_all, count(*) AS n_queries
FROM idcg i LEFT JOIN dw ON i.query = dw.query LEFT JOIN da ON i.query = da.query WHERE i.idcg > 0""",
    "merge_batch_predictions": f"""WITH {KNN},
b AS (SELECT query, url, position, query_id // {config.BATCH_SIZE} AS batch_id FROM pred
      UNION ALL
      SELECT query, url, position, query_id // {config.BATCH_SIZE} + 1 AS batch_id FROM pred WHERE position > {config.N_RESULTS} // 2),
m AS (SELECT query, max(batch_id) AS mb FROM b GROUP BY query)
SELECT b.query, b.url, b.position, b.batch_id FROM b JOIN m ON b.query = m.query AND b.batch_id = m.mb""",
    "global_row_id": """SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) - 1 AS row_id FROM documents""",
    "row_pair_alignment": f"""WITH {F1}
SELECT row_id, conv_id, turn, url, query, code FROM f1""",
    "split_80_10_10": f"""WITH {SPLIT}
SELECT row_id, split, split_pos FROM sp""",
    "shuffle_rows": f"""WITH {SPLIT}
SELECT row_id, split, shuffle_pos FROM sh""",
    "assign_batches": f"""WITH {SPLIT}
SELECT row_id, split, CASE WHEN split = 'train' THEN shuffle_pos // {config.BATCH_SIZE}
                           WHEN split = 'test' THEN split_pos // {config.MRR_POOL}
                           ELSE split_pos // {config.BATCH_SIZE} END AS batch_id FROM sh""",
    "tiny": f"""SELECT doc_id AS row_id, CAST(doc_id AS VARCHAR) AS url FROM documents
ORDER BY doc_id LIMIT {TINY_ROWS}""",
    "count_rows": """SELECT count(*) AS n_rows FROM documents""",
}

"""DuckDB SQL oracles for the text, encoder, language, index and run-metric queries."""

from __future__ import annotations

from lodestar import config
from lodestar.functions.text import PRETOKEN_PATTERN as PAT
from lodestar.operators.langid import ISO_LANGUAGES
from lodestar.plans.oracle import F1, NEG_INF, SPLIT, TOWERS, cos  # noqa: F401

WORD_VOCAB = config.VOCAB_SIZE
DIM = config.ENCODING_DIM
SEED = config.SEED
BPE_MERGES = 40
LSH = config.LshParams()
L_Q = config.QUERY_LENGTH
L_C = config.CODE_LENGTH


def md5u(key: str) -> str:
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def split_cte(source: str, id_col: str) -> str:
    """Hash-ordered exact 80/10/10 split over ``source(id_col)`` -> ``sp(row_id, split, split_pos)``."""
    return f"""sp0 AS (SELECT {id_col} AS row_id,
                row_number() OVER (ORDER BY md5('{SEED}:' || {id_col}), {id_col}) - 1 AS hpos FROM {source}),
sz0 AS (SELECT count(*) AS n, CAST(floor(0.1::DOUBLE * count(*)) AS BIGINT) AS nv,
               CAST(floor(0.1::DOUBLE * count(*)) AS BIGINT) AS nt FROM {source}),
sz AS (SELECT n - nv - nt AS ntr, nv, nt FROM sz0),
sp AS (SELECT row_id,
              CASE WHEN hpos < ntr THEN 'train' WHEN hpos < ntr + nv THEN 'valid' ELSE 'test' END AS split,
              hpos - CASE WHEN hpos < ntr THEN 0 WHEN hpos < ntr + nv THEN ntr ELSE ntr + nv END AS split_pos
       FROM sp0, sz)"""


F2 = f"""f2 AS (SELECT CAST(doc_id AS VARCHAR) AS url, source AS identifier,
       regexp_extract_all(text, '{PAT}') AS code_tokens,
       regexp_extract_all(text, '{PAT}') AS docstring_tokens, text AS docstring, doc_id AS row_id FROM documents)"""

CORPUS_SELECT = """SELECT url, identifier, array_to_string(code_tokens, ' ') AS code,
       array_to_string(docstring_tokens, ' ') AS query FROM f2"""

DOC_WORDS = f"""ds AS (SELECT text AS t FROM documents),
wc AS (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(t, '{PAT}')) AS w FROM ds) GROUP BY w)"""

WORD_VOCAB_CTE = f"""{F1},
st AS (SELECT code AS text FROM f1 UNION ALL SELECT query AS text FROM f1),
wcf AS (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '{PAT}')) AS w FROM st) GROUP BY w),
voc AS (SELECT word, CAST(row_number() OVER (ORDER BY cnt DESC, word) + 1 AS INTEGER) AS id FROM wcf
        QUALIFY row_number() OVER (ORDER BY cnt DESC, word) <= {WORD_VOCAB - 2})"""


def padded_tokens(name: str, field: str, length: int) -> str:
    """``{name}(row_id, pos 0-based, tok)``: word-vocab ids of ``f1.{field}`` padded to ``length``."""
    return f"""{name}_tk AS (SELECT x.row_id, x.pos, coalesce(v.id, 1) AS tok
       FROM (SELECT row_id, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos
             FROM (SELECT row_id, regexp_extract_all({field}, '{PAT}') AS toks FROM f1)) x
       LEFT JOIN voc v ON v.word = x.w),
{name} AS (SELECT g.row_id, g.p - 1 AS pos, coalesce(t.tok, 0) AS tok
       FROM (SELECT f1.row_id, r.p FROM f1, range(1, {length + 1}) r(p)) g
       LEFT JOIN {name}_tk t ON t.row_id = g.row_id AND t.pos = g.p)"""


def weights_cte(name: str, tower: str) -> str:
    """``{name}(pname, row, dim, value)``: md5-derived weights of one tower."""
    def block(pname: str, rows: int, dims: int, expr: str) -> str:
        key = f"'{tower}/{pname}:' || r || ':' || d"
        return (f"SELECT '{pname}' AS pname, r AS row, d AS dim, {expr.format(u=md5u(key))} AS value "
                f"FROM range(0, {rows}) a(r), range(0, {dims}) b(d)")
    parts = [
        block("embed", WORD_VOCAB, DIM, "CASE WHEN r = 0 THEN 0.0::DOUBLE ELSE ({u} - 0.5) * 2.0 END"),
        block("fc_weight", DIM, DIM, "({u} - 0.5) * 2.0"),
        block("fc_bias", 1, DIM, "({u} - 0.5) * 2.0"),
        block("bn_mean", 1, DIM, "({u} - 0.5) * 2.0"),
        block("bn_var", 1, DIM, "{u} + 0.5"),
        block("bn_weight", 1, DIM, "({u} - 0.5) * 2.0"),
        block("bn_bias", 1, DIM, "({u} - 0.5) * 2.0"),
    ]
    return f"{name} AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


def encode_ctes(prefix: str, tokens: str, weights: str, length: int) -> str:
    """pooled -> linear -> batch norm -> tanh, as ``{prefix}_enc(row_id, dim, value)``."""
    return f"""{prefix}_pool AS MATERIALIZED (SELECT p.row_id, e.dim, sum(e.value) / {float(length)} AS value
       FROM {tokens} p JOIN {weights} e ON e.pname = 'embed' AND e.row = p.tok GROUP BY p.row_id, e.dim),
{head_ctes(prefix, weights)}"""


def head_ctes(prefix: str, weights: str) -> str:
    """linear -> batch norm -> tanh over ``{prefix}_pool(row_id, dim, value)``."""
    one = ", ".join(f"max(value) FILTER (WHERE pname = '{p}') AS {p}" for p in ("fc_bias", "bn_mean", "bn_var", "bn_weight", "bn_bias"))
    return f"""{prefix}_hp AS MATERIALIZED (SELECT dim, {one} FROM {weights} WHERE pname NOT IN ('embed', 'fc_weight') GROUP BY dim),
{prefix}_fc AS MATERIALIZED (SELECT row, list(value ORDER BY dim) AS w FROM {weights} WHERE pname = 'fc_weight' GROUP BY row),
{prefix}_in AS MATERIALIZED (SELECT row_id, list(value ORDER BY dim) AS x FROM {prefix}_pool GROUP BY row_id),
{prefix}_enc AS (SELECT i.row_id, f.row AS dim,
       tanh((list_dot_product(f.w, i.x) + fc_bias - bn_mean) / sqrt(bn_var + {config.BATCHNORM_EPS}) * bn_weight + bn_bias) AS value
       FROM {prefix}_in i CROSS JOIN {prefix}_fc f JOIN {prefix}_hp h ON h.dim = f.row)"""


ENCODER_BASE = f"""{WORD_VOCAB_CTE},
{padded_tokens('qt', 'query', L_Q)},
{weights_cte('ws', 'shared')}"""

LANGID = f"""tri AS (SELECT lang, g AS gram, count(*) AS n FROM (
         SELECT lang, unnest(list_transform(range(1, length(lt) - 1), lambda i: substring(lt, i, 3))) AS g
         FROM (SELECT lang, lower(text) AS lt FROM documents)) GROUP BY lang, g),
tot AS (SELECT lang, sum(n) AS total FROM tri GROUP BY lang),
nv AS (SELECT count(DISTINCT gram) AS v FROM tri),
dsg AS (SELECT doc_id, gram, count(*) AS occ FROM (
         SELECT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram
         FROM (SELECT doc_id, lower(text) AS t FROM documents)) GROUP BY doc_id, gram),
iv AS (SELECT * FROM dsg WHERE gram IN (SELECT gram FROM tri)),
nocc AS (SELECT doc_id, sum(occ) AS n_occ FROM iv GROUP BY doc_id),
seen AS (SELECT iv.doc_id, m.lang, sum(iv.occ * ln(m.n + 1)) AS s FROM iv JOIN tri m ON iv.gram = m.gram
         GROUP BY iv.doc_id, m.lang),
grid AS (SELECT n.doc_id, t.lang, coalesce(s.s, 0) - n.n_occ * ln(t.total + nv.v) AS score
         FROM nocc n CROSS JOIN tot t CROSS JOIN nv LEFT JOIN seen s ON s.doc_id = n.doc_id AND s.lang = t.lang),
best AS (SELECT doc_id, max(score) AS mx, first(lang ORDER BY score DESC, lang) AS lang_pred FROM grid GROUP BY doc_id),
pr AS (SELECT g.doc_id, b.lang_pred, 1.0 / sum(exp(g.score - b.mx)) AS lang_prob
       FROM grid g JOIN best b ON g.doc_id = b.doc_id GROUP BY g.doc_id, b.lang_pred)"""

_DEPTH = (f"(SELECT greatest(CASE WHEN count(*) > {LSH.bucket_rows} THEN ceil(log2(count(*) / {LSH.bucket_rows}.0)) ELSE 0 END, 0)::INT "
          "AS depth, count(*) AS n FROM t)")
PLANES = f"""pl0 AS (SELECT b, d, CASE WHEN {md5u(f"'{SEED}:' || b || ':' || d")} < 0.5
                             THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s
        FROM range(0, {LSH.n_bits}) y(b), range(0, 64) z(d)),
pl AS MATERIALIZED (SELECT b, list(s ORDER BY d) AS p FROM pl0 GROUP BY b),
dp AS {_DEPTH},
cb AS MATERIALIZED (SELECT c.row_id AS code_id, pl.b, list_dot_product(c.cv, pl.p) >= 0 AS bit FROM t c, pl),
bk AS MATERIALIZED (SELECT code_id, coalesce(sum(CASE WHEN bit AND b < depth THEN 1 << b END), 0)::BIGINT AS bucket FROM cb, dp GROUP BY code_id)"""
# margins of a query, the neighbouring buckets no trusted bit forbids (all of them are within n_probes here), estimates
PROBES = f"""qm AS MATERIALIZED (SELECT q.row_id AS query_id, pl.b,
                 list_dot_product(q.qv, pl.p) / sqrt(list_dot_product(q.qv, q.qv)) AS z FROM t q, pl),
pb AS (SELECT query_id, u.bucket FROM qm, dp, (SELECT range AS bucket FROM range(0, (SELECT (1 << depth)::BIGINT FROM dp))) u
       GROUP BY query_id, u.bucket
       HAVING bool_and(b >= depth OR abs(z) <= {LSH.margin} OR (z >= 0) = (((u.bucket >> b::BIGINT) & 1) = 1))),
qz AS (SELECT query_id, list(z ORDER BY b) AS z FROM qm GROUP BY query_id),
cz AS (SELECT code_id, list(CASE WHEN bit THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY b) AS s FROM cb GROUP BY code_id),
es AS (SELECT pb.query_id, bk.code_id, round(list_dot_product(qz.z, cz.s), 6) AS e
       FROM pb JOIN bk USING (bucket) JOIN qz USING (query_id) JOIN cz USING (code_id)),
cand AS (SELECT query_id, code_id FROM es
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY e DESC, code_id)
                 <= greatest({config.N_RESULTS}, ceil({LSH.oversample} * sqrt({config.N_RESULTS} * (SELECT n FROM dp)))))"""

HISTORY = """ev AS (SELECT user_id AS run_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch,
               value / 100.0 AS v FROM events)"""


def _sweep_u(name: str) -> str:
    return md5u(f"'{SEED}:' || run_id || ':{name}'")


ISO_VALUES = ", ".join(f"('{n}', '{a}')" for n, a in sorted(ISO_LANGUAGES.items()))

ORACLE_TEXT = {
    "read_pairs_jsonl": f"WITH {F2}\n{CORPUS_SELECT}",
    "corpus_projection": f"WITH {F2}\n{CORPUS_SELECT}",
    "eval_projection": f"WITH {F2}\n{CORPUS_SELECT}",
    "project_field": f"""WITH {F2}, c AS (SELECT row_id, array_to_string(code_tokens, ' ') AS code FROM f2)
SELECT row_id, field, md5(code) AS digest FROM c CROSS JOIN (VALUES ('code'), ('query')) AS f(field)""",
    "label_intersection": """SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS name FROM documents WHERE lang IN ('en', 'fr')
UNION ALL SELECT DISTINCT 'source' AS kind, source AS name FROM documents WHERE lang IN ('en', 'fr')""",
    "corpus_select": """SELECT true AS training, CAST(doc_id AS VARCHAR) AS url, source AS identifier FROM documents WHERE lang IN ('en', 'fr')
UNION ALL SELECT false AS training, CAST(doc_id AS VARCHAR) AS url, source AS identifier FROM documents""",
    "single_line_docstrings": """SELECT doc_id AS row_id, length(text) AS n_chars, md5(replace(text, chr(10), ' ')) AS digest FROM documents""",
    "pair_geometry": f"""WITH {TOWERS}
SELECT row_id, round(sqrt(list_dot_product(qv, qv)), 6) AS query_norm, round(sqrt(list_dot_product(cv, cv)), 6) AS code_norm,
       round(CASE WHEN {cos('qv', 'cv')} IS NULL THEN NULL ELSE sqrt(greatest(2 * (1 - {cos('qv', 'cv')}), 0)) END, 6) AS distance FROM t""",
    "scan_splits": f"""WITH {split_cte('documents', 'doc_id')}
SELECT CAST(d.doc_id AS VARCHAR) AS url, d.source AS identifier, sp.split,
       CAST(CASE sp.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS INTEGER) AS split_order
FROM documents d JOIN sp ON sp.row_id = d.doc_id""",
    "prepare_corpus": f"""WITH {split_cte('documents', 'doc_id')},
c AS (SELECT CAST(d.doc_id AS VARCHAR) AS url, d.source AS identifier, sp.split,
             CASE sp.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS so
      FROM documents d JOIN sp ON sp.row_id = d.doc_id)
SELECT row_number() OVER (ORDER BY so, url) - 1 AS row_id, url, identifier, split FROM c""",
    "read_queries": """SELECT regexp_replace(regexp_replace(line, '^\\s+', ''), '\\s+$', '') AS value
FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS line FROM benchmark)""",
    "text_stream": f"""WITH {F1}
SELECT row_id, 'code' AS field, code AS text FROM f1 UNION ALL SELECT row_id, 'query' AS field, query AS text FROM f1""",
    "pretokenize": f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{PAT}')) AS BIGINT) AS n_tokens,
       array_to_string(regexp_extract_all(text, '{PAT}'), ' ') AS tokens FROM documents""",
    "word_counts": f"WITH {DOC_WORDS}\nSELECT word, cnt FROM wc",
    "alphabet": f"""WITH {DOC_WORDS}
SELECT DISTINCT unnest(list_transform(range(1, length(word) + 1), lambda i: substring(word, i, 1))) AS symbol FROM wc""",
    "bpe_pair_counts": f"""WITH {DOC_WORDS}
SELECT substring(word, i, 1) AS "left", substring(word, i + 1, 1) AS "right", CAST(sum(cnt) AS BIGINT) AS cnt
FROM (SELECT word, cnt, unnest(range(1, length(word))) AS i FROM wc WHERE length(word) >= 2)
GROUP BY 1, 2""",
    "pluggable_tokenizer": f"""WITH {F1}
SELECT row_id, array_to_string(list_slice(list_concat(
         list_transform(range(1, length(query) + 1), lambda i: unicode(substring(query, i, 1))),
         list_transform(range({L_Q}), lambda j: 0)), 1, {L_Q}), ' ') AS ids FROM f1""",
    "pad_truncate": f"""WITH {ENCODER_BASE}
SELECT row_id, array_to_string(list(tok ORDER BY pos), ' ') AS ids FROM qt GROUP BY row_id""",
    "embed_lookup": f"""WITH {ENCODER_BASE}
SELECT q.row_id, CAST(q.pos AS BIGINT) AS pos, CAST(q.tok AS BIGINT) AS token_id, CAST(e.dim AS BIGINT) AS dim,
       round(e.value, 6) AS value
FROM qt q JOIN ws e ON e.pname = 'embed' AND e.row = q.tok""",
    "mean_pool": f"""WITH {ENCODER_BASE},
{encode_ctes('s', 'qt', 'ws', L_Q)}
SELECT row_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM s_pool""",
    "nbow_encode": f"""WITH {ENCODER_BASE},
{encode_ctes('s', 'qt', 'ws', L_Q)}
SELECT row_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM s_enc""",
    "encode_pair": f"""WITH {WORD_VOCAB_CTE},
{padded_tokens('qt', 'query', L_Q)},
{padded_tokens('ct', 'code', L_C)},
{weights_cte('wq', 'query')},
{weights_cte('wc2', 'code')},
{encode_ctes('qq', 'qt', 'wq', L_Q)},
{encode_ctes('cc', 'ct', 'wc2', L_C)}
SELECT row_id, 'code' AS side, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM cc_enc
UNION ALL
SELECT row_id, 'query' AS side, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM qq_enc""",
    "batchnorm_stats": """SELECT CAST(i - 1 AS BIGINT) AS dim, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var,
       count(*) AS n
FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
GROUP BY i""",
    "token_frequency": f"""WITH {ENCODER_BASE}
SELECT row_id // {config.BATCH_SIZE} AS batch_id, CAST(tok AS BIGINT) AS token_id, count(*) AS freq
FROM qt GROUP BY 1, 2""",
    "langid_fit": f"WITH {LANGID}\nSELECT lang, gram, n FROM tri",
    "langid_predict": f"""WITH {LANGID}
SELECT d.doc_id, pr.lang_pred, round(pr.lang_prob, 6) AS lang_prob FROM documents d LEFT JOIN pr ON pr.doc_id = d.doc_id""",
    "filter_nl": f"""WITH {LANGID}
SELECT CAST(doc_id AS VARCHAR) AS url FROM pr WHERE lang_pred IN ('en', 'fr') AND lang_prob >= {config.LANGID_THRESHOLD}""",
    "nl_labels": f"""WITH iso(name, alpha2) AS (VALUES {ISO_VALUES})
SELECT d.lang, i.name, '__label__' || i.alpha2 AS label, count(*) AS n_docs
FROM documents d LEFT JOIN iso i ON d.lang = i.alpha2 GROUP BY d.lang, i.name, i.alpha2""",
    "index_build": f"""WITH {TOWERS},
{PLANES},
wd AS (SELECT code_id, b // 32 AS w, sum(CASE WHEN bit THEN 1::BIGINT << (31 - b % 32) ELSE 0 END) AS v FROM cb GROUP BY ALL)
SELECT code_id, bucket, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY w) AS signature FROM wd JOIN bk USING (code_id) GROUP BY ALL""",
    "knn_approx": f"""WITH {TOWERS},
{PLANES},
{PROBES},
cnt AS (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id),
sc AS (SELECT q.row_id AS query_id, c.row_id AS code_id, {cos('q.qv', 'c.cv')} AS score FROM t q CROSS JOIN t c),
pool AS (SELECT sc.* FROM sc JOIN cand ON sc.query_id = cand.query_id AND sc.code_id = cand.code_id
         WHERE sc.query_id IN (SELECT query_id FROM cnt, dp WHERE cnt.n >= least({config.N_RESULTS}, dp.n))
         UNION ALL
         SELECT sc.* FROM sc WHERE sc.query_id NOT IN (SELECT query_id FROM cnt, dp WHERE cnt.n >= least({config.N_RESULTS}, dp.n))),
k AS (SELECT query_id, code_id, score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, code_id) AS BIGINT) AS position
      FROM pool QUALIFY position <= {config.N_RESULTS})
SELECT query_id, code_id, position, round(score, 6) AS score FROM k""",
    "best_checkpoints": f"""WITH {HISTORY}
SELECT run_id, epoch, round(v, 6) AS valid_loss,
       CAST(row_number() OVER (PARTITION BY run_id ORDER BY v, epoch) AS BIGINT) AS ckpt_rank
FROM ev QUALIFY ckpt_rank <= 3""",
    "early_stop": f"""WITH RECURSIVE {HISTORY},
st AS (
  SELECT run_id, CAST(0 AS BIGINT) AS epoch, 'inf'::DOUBLE AS best, CAST(NULL AS BIGINT) AS best_epoch,
         0 AS wait, CAST(NULL AS BIGINT) AS stop
  FROM (SELECT DISTINCT run_id FROM ev)
  UNION ALL
  SELECT s.run_id, e.epoch,
         CASE WHEN isfinite(e.v) AND e.v < s.best - {config.EARLY_STOP_MIN_DELTA} THEN e.v ELSE s.best END,
         CASE WHEN isfinite(e.v) AND e.v < s.best - {config.EARLY_STOP_MIN_DELTA} THEN e.epoch ELSE s.best_epoch END,
         CASE WHEN isfinite(e.v) AND e.v < s.best - {config.EARLY_STOP_MIN_DELTA} THEN 0 ELSE s.wait + 1 END,
         CASE WHEN NOT isfinite(e.v) THEN e.epoch
              WHEN NOT (e.v < s.best - {config.EARLY_STOP_MIN_DELTA}) AND s.wait + 1 >= {config.EARLY_STOP_PATIENCE}
              THEN e.epoch END
  FROM st s JOIN ev e ON e.run_id = s.run_id AND e.epoch = s.epoch + 1
  WHERE s.stop IS NULL),
fin AS (SELECT run_id, max(stop) AS stop_epoch, arg_max(best_epoch, epoch) AS best_epoch,
               arg_max(best, epoch) AS best_value FROM st GROUP BY run_id),
nc AS (SELECT run_id, count(*) AS n_checks FROM ev GROUP BY run_id)
SELECT fin.run_id, stop_epoch, best_epoch,
       CASE WHEN best_epoch IS NULL THEN NULL ELSE round(best_value, 6) END AS best_value, n_checks
FROM fin JOIN nc ON fin.run_id = nc.run_id""",
    "sweep_trials": f"""WITH {HISTORY},
per AS (SELECT run_id, min(v) AS best_valid_loss FROM ev GROUP BY run_id),
bst AS (SELECT run_id FROM per ORDER BY best_valid_loss, run_id LIMIT 1)
SELECT run_id,
       round(exp(-8.0 + 7.0 * {_sweep_u('learning_rate')}), 6) AS learning_rate,
       round(0.8 + 0.8 * {_sweep_u('gradient_clip_val')}, 6) AS gradient_clip_val,
       round(0.0 + 0.5 * {_sweep_u('encoder_dropout')}, 6) AS encoder_dropout,
       [16, 32, 64, 128][CAST(floor({_sweep_u('embedding_dim')} * 4) AS INTEGER) + 1] AS embedding_dim,
       [16, 32, 64, 128][CAST(floor({_sweep_u('encoding_dim')} * 4) AS INTEGER) + 1] AS encoding_dim,
       round(best_valid_loss, 6) AS best_valid_loss,
       run_id = (SELECT run_id FROM bst) AS is_best
FROM per""",
}

# the annotation CSV round trip answers the same question as mean_relevance
from lodestar.plans.oracle import ORACLE as _BASE  # noqa: E402

ORACLE_TEXT["read_annotations_csv"] = _BASE["mean_relevance"]

ORACLE_TEXT["passage_annotations"] = """SELECT lower(regexp_replace(regexp_replace(b.text, '^\\s+', ''), '\\s+$', '')) AS query,
       CAST(d.doc_id AS VARCHAR) AS url, round(avg(3.0), 6) AS relevance
FROM documents d JOIN benchmark b ON length(b.text) > 0 AND contains(d.text, b.text)
GROUP BY 1, 2"""

ORACLE_TEXT["ingest_stream"] = f"""WITH {F2}, {split_cte('documents', 'doc_id')}
SELECT f2.url, f2.identifier, array_to_string(f2.code_tokens, ' ') AS code,
       array_to_string(f2.docstring_tokens, ' ') AS query, sp.split
FROM f2 JOIN sp ON sp.row_id = f2.row_id"""

ORACLE_TEXT["path_layout"] = """WITH per AS (SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source),
k AS (SELECT source, coalesce(nullif(array_to_string(langs, '_'), ''), 'all') AS nl_dir FROM per)
SELECT source, nl_dir, 'data/' || source || '/' || nl_dir AS model_dir,
       upper(substring(source, 1, 1)) || lower(substring(source, 2)) AS source_cap FROM k"""
ORACLE_TEXT["run_names"] = """SELECT user_id, strftime(min(ts), '%y%m%d_%H%M') AS run_id FROM events GROUP BY user_id"""

# E3 with the registered sinusoidal encoder: state[l, d] = sin(token_l * (d + 1) / DIM)
ORACLE_TEXT["encode_with"] = f"""WITH {ENCODER_BASE},
ew_pool AS MATERIALIZED (SELECT p.row_id, dd.d AS dim, sum(sin(p.tok * ((dd.d + 1) / {float(DIM)}::DOUBLE))) / {float(L_Q)} AS value
            FROM qt p, range(0, {DIM}) dd(d) GROUP BY p.row_id, dd.d),
{head_ctes('ew', 'ws')}
SELECT row_id, CAST(dim AS BIGINT) AS dim, round(value, 6) AS value FROM ew_enc"""

from lodestar.plans.oracle import RANKS  # noqa: E402


def _word_pools(split_name: str, pool: int) -> str:
    return f"""{WORD_VOCAB_CTE},
{padded_tokens('qt', 'query', L_Q)},
{padded_tokens('ct', 'code', L_C)},
{weights_cte('ws', 'shared')},
{encode_ctes('qq', 'qt', 'ws', L_Q)},
{encode_ctes('cc', 'ct', 'ws', L_C)},
{split_cte('f1', 'row_id')},
qv AS (SELECT row_id, list(value ORDER BY dim) AS v FROM qq_enc GROUP BY row_id),
cv AS (SELECT row_id, list(value ORDER BY dim) AS v FROM cc_enc GROUP BY row_id),
p AS (SELECT sp.row_id, sp.split_pos // {pool} AS batch_id, qv.v AS qv, cv.v AS cv
      FROM sp JOIN qv ON qv.row_id = sp.row_id JOIN cv ON cv.row_id = sp.row_id WHERE sp.split = '{split_name}'),
{RANKS}"""


ORACLE_TEXT["test_mrr_words"] = f"""WITH {_word_pools('test', config.MRR_POOL)}
SELECT round(avg(1.0 / rank), 6) AS mrr, count(*) AS n_queries, CAST({config.MRR_POOL} AS BIGINT) AS pool_size FROM r"""
ORACLE_TEXT["validate_words"] = f"""WITH {_word_pools('valid', config.BATCH_SIZE)}
SELECT round(avg(1 - target_score + hardest_negative), 6) AS valid_loss, round(avg(1.0 / rank), 6) AS valid_mrr,
       count(*) AS n_queries FROM r"""

ORACLE_TEXT["training_batches"] = f"""WITH {SPLIT}
SELECT row_id, split, CASE WHEN split = 'train' THEN shuffle_pos // {config.BATCH_SIZE}
                           WHEN split = 'test' THEN split_pos // {config.MRR_POOL}
                           ELSE split_pos // {config.BATCH_SIZE} END AS batch_id,
       CAST({config.CODE_LENGTH} AS BIGINT) AS code_length, CAST({config.QUERY_LENGTH} AS BIGINT) AS query_length FROM sh"""

DAILY = """dr AS (SELECT event_type AS run_id, CAST(day(ts) AS BIGINT) AS epoch, avg(value) / 100.0 AS v FROM events GROUP BY ALL)"""
ORACLE_TEXT["metrics_sink"] = f"""WITH {DAILY}
SELECT run_id, 'valid' AS split, epoch, 'valid/loss' AS metric, round(v, 6) AS value FROM dr"""
ORACLE_TEXT["served_checkpoints"] = f"""WITH {DAILY}
SELECT run_id, epoch, row_number() OVER (PARTITION BY run_id ORDER BY v, epoch) AS rank
FROM dr WHERE epoch IN (3, 9, 15, 21, 27) QUALIFY rank <= 3"""

ORACLE_TEXT["prepare_corpus_filtered"] = f"""WITH {split_cte('documents', 'doc_id')}, {LANGID},
c AS (SELECT CAST(d.doc_id AS VARCHAR) AS url, d.source AS identifier, sp.split,
             CASE sp.split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END AS so
      FROM documents d JOIN sp ON sp.row_id = d.doc_id JOIN pr ON pr.doc_id = d.doc_id
      WHERE pr.lang_pred IN ('en', 'fr') AND pr.lang_prob >= {config.LANGID_THRESHOLD})
SELECT row_number() OVER (ORDER BY so, url) - 1 AS row_id, url, identifier, split FROM c"""

# B3-B5 at a vocabulary of BPE_MERGES merges: symbols stand between two marks, so one replace merges a pair left to right
BPE = f"""WITH RECURSIVE {WORD_VOCAB_CTE.split('voc AS')[0].rstrip().rstrip(',')},
bp AS (
  SELECT 0 AS it, word, cnt, array_to_string(list_transform(string_split(word, ''), lambda c: chr(1) || c || chr(2)), '') AS s,
         '' AS l, '' AS r FROM wcf
  UNION ALL
  SELECT it + 1, word, cnt, replace(s, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)), b.l, b.r
  FROM bp, (SELECT t[i] AS l, t[i + 1] AS r FROM (
              SELECT t, cnt, unnest(range(1, len(t))) AS i FROM (
                SELECT string_split(substr(s, 2, length(s) - 2), chr(2) || chr(1)) AS t, cnt FROM bp))
            GROUP BY ALL ORDER BY sum(cnt) DESC LIMIT 1) b
  WHERE it < {BPE_MERGES})"""
ORACLE_TEXT["bpe_merges"] = f"""{BPE}
SELECT DISTINCT CAST(it - 1 AS INTEGER) AS rank, l AS "left", r AS "right" FROM bp WHERE it > 0"""
ORACLE_TEXT["bpe_tokens"] = f"""{BPE},
fin AS (SELECT word, replace(substr(s, 2, length(s) - 2), chr(2) || chr(1), ' ') AS t FROM bp WHERE it = {BPE_MERGES}),
tk AS (SELECT row_id, field, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM (
         SELECT row_id, 'code' AS field, regexp_extract_all(code, '{PAT}') AS toks FROM f1
         UNION ALL SELECT row_id, 'query', regexp_extract_all(query, '{PAT}') FROM f1))
SELECT row_id, field, string_agg(t, ' ' ORDER BY pos) AS tokens FROM tk JOIN fin ON fin.word = tk.w GROUP BY ALL"""

"""Registered queries over text: sources, corpus, tokenizer, encoder, language id,
index and run metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar import config
from lodestar.config import LshParams
from lodestar.functions.text import pretokens, strip_newlines
from lodestar.functions.vector import angular_distance, cosine, l2_norm
from lodestar.operators import bpe, corpus, encoder, langid, lsh, rowid, train
from lodestar.plans import fixtures as fx
from lodestar.plans.common import rounded
from lodestar.session import scratch_path
from lodestar.sources import files, runs, stores

WORD_VOCAB = config.VOCAB_SIZE
DIM = config.ENCODING_DIM
NL_FILTER = ("english", "french")


# ------------------------------------------------------------- sources ----
def _raw(spark, sf_dir):
    return fx.raw_records(spark, sf_dir)


def q_read_pairs_jsonl(spark, sf_dir):
    path = scratch_path(spark, "pairs-jsonl")
    files.write_jsonl(_raw(spark, sf_dir).drop("row_id"), path)
    back = files.read_jsonl(spark, path, files.RAW_SCHEMA)
    return corpus.corpus_projection(back).select("url", "identifier", "code", "query")


def _write_raw_splits(spark, sf_dir, root):
    """The raw records as split directories; texts are tokenized where they are written, after the join with the split."""
    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("row_id", F.col("doc_id").cast("long"))
    split = rowid.split_80_10_10(docs.select("row_id"))
    tagged = docs.join(split.select("row_id", "split"), "row_id").drop("row_id")
    files.write_splits(tagged, root, "python", project=lambda rows: fx.raw_fields(rows).drop("row_id"))


def q_scan_splits(spark, sf_dir):
    root = scratch_path(spark, "raw-splits")
    _write_raw_splits(spark, sf_dir, root)
    back = files.scan_splits(spark, root, "python")
    return back.select("url", F.col("func_name").alias("identifier"), "split", "split_order")


def q_corpus_projection(spark, sf_dir):
    return corpus.corpus_projection(_raw(spark, sf_dir)).select("url", "identifier", "code", "query")


def q_project_field(spark, sf_dir):
    """P6 over P1: the two fields to tokenize, one after the other."""
    pairs = corpus.corpus_projection(_raw(spark, sf_dir))
    code, query = (corpus.project_field(pairs, f).select("row_id", F.lit(f).alias("field"), F.md5("text").alias("digest"))
                   for f in ("code", "query"))
    return code.unionByName(query)


def _wanted(labels):
    """The label set holds one of the wanted languages' labels."""
    return corpus.label_intersection(labels, F.array(*[F.lit(x) for x in langid.nl_labels(list(NL_FILTER))]))


def q_label_intersection(spark, sf_dir):
    """Sources by the labels of all their documents, and documents by their own."""
    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("__label__"), "lang").alias("label"))
    sources = docs.groupBy("source").agg(F.collect_set("label").alias("labels")).where(_wanted(F.col("labels")))
    own = docs.where(_wanted(F.array("label")))
    return (sources.select(F.lit("source").alias("kind"), F.col("source").alias("name"))
            .unionByName(own.select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("name"))))


def q_corpus_select(spark, sf_dir):
    """P10: the language-filtered corpus when training, all definitions otherwise."""
    labels = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.concat(F.lit("__label__"), "lang").alias("label"))
    kept = _raw(spark, sf_dir).join(labels.where(_wanted(F.array("label"))), "row_id", "left_semi")
    training, evaluation = corpus.corpus_projection(kept), corpus.eval_projection(fx.definition_records(spark, sf_dir))
    chosen = [corpus.corpus_select(on, training, evaluation).select(F.lit(on).alias("training"), "url", "identifier") for on in (True, False)]
    return chosen[0].unionByName(chosen[1])


def q_single_line_docstrings(spark, sf_dir):
    """Every docstring on one line."""
    line = strip_newlines("docstring")
    return _raw(spark, sf_dir).select("row_id", F.length(line).cast("long").alias("n_chars"), F.md5(line).alias("digest"))


def q_pair_geometry(spark, sf_dir):
    """Norms, cosine and angular distance of every pair of towers."""
    return rounded(fx.towers(spark, sf_dir).select(
        "row_id", l2_norm("query_vec").alias("query_norm"), l2_norm("code_vec").alias("code_norm"),
        angular_distance(cosine("query_vec", "code_vec")).alias("distance")))


def q_eval_projection(spark, sf_dir):
    """S6 + P2: the definition set stored as Parquet, read back, projected."""
    path = scratch_path(spark, "definitions")
    fx.definition_records(spark, sf_dir).drop("row_id").write.parquet(path)
    defs = files.definitions_source(spark, path)
    return corpus.eval_projection(defs).select("url", "identifier", "code", "query")


def q_read_annotations_csv(spark, sf_dir):
    from lodestar.operators import relevance as rel
    path = scratch_path(spark, "annotations-csv")
    files.write_annotations_csv(fx.annotation_rows(spark, sf_dir), path)
    back = files.read_annotations_csv(spark, path)
    return rounded(rel.mean_relevance(back, "python"))


def q_read_queries(spark, sf_dir):
    path = scratch_path(spark, "queries-txt")
    files.write_lines(fx.load(spark, sf_dir, "benchmark"), "text", path)
    return files.read_queries(spark, path)


def q_text_stream(spark, sf_dir):
    return fx.text_stream(spark, sf_dir).select("row_id", "field", "text")


# ----------------------------------------------------------- tokenizer ----
def _doc_stream(spark, sf_dir) -> DataFrame:
    return fx.load(spark, sf_dir, "documents").select("text")


def q_pretokenize(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    toks = pretokens("text")
    return docs.select("doc_id", F.size(toks).cast("bigint").alias("n_tokens"),
                       F.array_join(toks, " ").alias("tokens"))


def q_word_counts(spark, sf_dir):
    return bpe.word_counts(_doc_stream(spark, sf_dir))


def q_alphabet(spark, sf_dir):
    return bpe.alphabet(bpe.word_counts(_doc_stream(spark, sf_dir)))


def q_bpe_pair_counts(spark, sf_dir):
    return bpe.bpe_pair_counts(bpe.word_counts(_doc_stream(spark, sf_dir)))


def _bpe_model(spark, sf_dir) -> bpe.BpeModel:
    return bpe.bpe_train(bpe.word_counts(fx.text_stream(spark, sf_dir)))


def q_bpe_train(spark, sf_dir):
    model = _bpe_model(spark, sf_dir)
    return model.vocab_frame(spark)


BPE_MERGES = 40            # the small models of the keys that SQL checks


def _small_model(spark, sf_dir) -> bpe.BpeModel:
    words = bpe.word_counts(fx.text_stream(spark, sf_dir)).checkpoint(eager=True)
    size = bpe.alphabet(words).count() + len(config.SPECIAL_TOKENS) + BPE_MERGES
    return bpe.bpe_train(words, vocab_size=size, min_count=1)


def q_bpe_merges(spark, sf_dir):
    """The first merges over all words of the corpus."""
    model = _small_model(spark, sf_dir)
    token = {i: t for t, i in model.vocab.items()}
    rows = [(rank, token[a], token[b]) for rank, (a, b, _) in enumerate(model.merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string")


def q_bpe_tokens(spark, sf_dir):
    """Both whole texts of every pair as tokens of the small model."""
    model = _small_model(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for t, i in model.vocab.items() for x in (i, t)])
    pairs = fx.text_pairs(spark, sf_dir)
    both = pairs.select("row_id", F.inline(F.array(F.struct(F.lit("code").alias("field"), F.col("code").alias("text")),
                                                   F.struct(F.lit("query").alias("field"), F.col("query").alias("text")))))
    ids = bpe.bpe_encode(both, "text", model, None, "ids").where(F.size("ids") > 0)
    return ids.select("row_id", "field", F.array_join(F.transform("ids", lambda i: F.element_at(names, i)), " ").alias("tokens"))


def q_bpe_encode(spark, sf_dir):
    model = _bpe_model(spark, sf_dir)
    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "text")
    enc = bpe.bpe_encode(docs, "text", model, None, "all_ids")
    return enc.select("doc_id", F.size("all_ids").cast("bigint").alias("n_ids"),
                      F.array_join(bpe.pad_truncate("all_ids", config.CODE_LENGTH), " ").alias("ids"))


def q_tokenize_fields(spark, sf_dir):
    model = _bpe_model(spark, sf_dir)
    pairs = fx.text_pairs(spark, sf_dir)
    tok = bpe.tokenize_fields(pairs, model)
    return tok.select("row_id", F.array_join("code_ids", " ").alias("code_ids"),
                      F.array_join("query_ids", " ").alias("query_ids"))


def _char_tokenizer(text: str) -> list[int]:
    """A user tokenizer: one id per character, its code point."""
    return [ord(c) for c in text]


def q_pluggable_tokenizer(spark, sf_dir):
    pairs = fx.text_pairs(spark, sf_dir)
    tok = bpe.tokenize_with(pairs, "query", _char_tokenizer, config.QUERY_LENGTH)
    return tok.select("row_id", F.array_join("ids", " ").alias("ids"))


def _word_vocab(spark, sf_dir):
    return bpe.word_vocab(bpe.word_counts(fx.text_stream(spark, sf_dir)), WORD_VOCAB)


def _word_ids(spark, sf_dir, field="query", length=config.QUERY_LENGTH, out="ids"):
    pairs = fx.text_pairs(spark, sf_dir)
    return bpe.word_encode(pairs, field, _word_vocab(spark, sf_dir), length, out)


def q_pad_truncate(spark, sf_dir):
    return _word_ids(spark, sf_dir).select("row_id", F.array_join("ids", " ").alias("ids"))


# ------------------------------------------------------------- encoder ----
def _weights(spark, tower="shared"):
    return encoder.md5_weights(spark, tower, WORD_VOCAB, DIM, DIM)


def _long_vec(df: DataFrame, vec_col: str, *keys: str) -> DataFrame:
    return rounded(df.select(*keys, F.posexplode(vec_col).alias("dim", "value"))
                     .withColumn("dim", F.col("dim").cast("bigint")))


def q_embed_lookup(spark, sf_dir):
    ids = _word_ids(spark, sf_dir)
    looked = encoder.embed_lookup(ids, "ids", _weights(spark))
    return _long_vec(looked.withColumn("pos", F.col("pos").cast("bigint"))
                           .withColumn("token_id", F.col("token_id").cast("bigint")),
                     "vec", "row_id", "pos", "token_id")


def q_mean_pool(spark, sf_dir):
    return _long_vec(encoder.mean_pool(_word_ids(spark, sf_dir), "ids", _weights(spark)), "pooled", "row_id")


def q_nbow_encode(spark, sf_dir):
    return _long_vec(encoder.nbow_encode(_word_ids(spark, sf_dir), "ids", _weights(spark)), "vec", "row_id")


def q_encode_pair(spark, sf_dir):
    pairs = fx.text_pairs(spark, sf_dir)
    vocab = _word_vocab(spark, sf_dir)
    tok = bpe.word_encode(bpe.word_encode(pairs, "code", vocab, config.CODE_LENGTH, "code_ids"),
                          "query", vocab, config.QUERY_LENGTH, "query_ids")
    w = _weights(spark, "code").unionByName(_weights(spark, "query"))
    enc = encoder.encode_pair(tok, w, shared=False)
    code = _long_vec(enc.select("row_id", F.lit("code").alias("side"), F.col("code_vec").alias("v")),
                     "v", "row_id", "side")
    query = _long_vec(enc.select("row_id", F.lit("query").alias("side"), F.col("query_vec").alias("v")),
                      "v", "row_id", "side")
    return code.unionByName(query)


def _toy_states():
    """A user encoder: sinusoidal features of each token id, (B, L) -> (B, L, D)."""
    freqs = np.arange(1, DIM + 1, dtype=np.float64) / DIM

    def run(ids: np.ndarray) -> np.ndarray:
        return np.sin(ids[..., None].astype(np.float64) * freqs)
    return run


def q_encode_with(spark, sf_dir):
    enc = encoder.encode_with(_word_ids(spark, sf_dir), "ids", _toy_states, _weights(spark))
    return _long_vec(enc, "vec", "row_id")


def q_batchnorm_stats(spark, sf_dir):
    e = fx.load(spark, sf_dir, "embeddings")
    return rounded(encoder.batchnorm_stats(e, "embedding").withColumn("dim", F.col("dim").cast("bigint")))


def q_token_frequency(spark, sf_dir):
    ids = rowid.assign_batches(_word_ids(spark, sf_dir), config.BATCH_SIZE, pos_col="row_id")
    return encoder.token_frequency(ids, "ids").withColumn("token_id", F.col("token_id").cast("bigint"))


# ------------------------------------------------------------ language ----
def _langid_model(spark, sf_dir):
    return langid.langid_fit(fx.load(spark, sf_dir, "documents"), "text", "lang")


def _docstrings(spark, sf_dir):
    return _raw(spark, sf_dir).select("row_id", "url", "docstring")


def q_langid_fit(spark, sf_dir):
    return _langid_model(spark, sf_dir)


def q_langid_predict(spark, sf_dir):
    pred = langid.langid_predict(_docstrings(spark, sf_dir), _langid_model(spark, sf_dir), "docstring")
    return rounded(pred.select(F.col("row_id").alias("doc_id"), "lang_pred", "lang_prob"))


def q_filter_nl(spark, sf_dir):
    pred = langid.langid_predict(_docstrings(spark, sf_dir), _langid_model(spark, sf_dir), "docstring")
    return langid.filter_nl(pred, list(NL_FILTER)).select("url")


def q_nl_labels(spark, sf_dir):
    docs = fx.load(spark, sf_dir, "documents")
    iso = langid.iso_languages(spark)
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return (counts.join(F.broadcast(iso), counts["lang"] == iso["alpha2"], "left")
                  .select("lang", "name", F.concat(F.lit("__label__"), F.col("alpha2")).alias("label"), "n_docs"))


# --------------------------------------------------------------- index ----
def q_index_build(spark, sf_dir):
    index = lsh.index_build(fx.search_corpus(spark, sf_dir), LshParams())
    return index.select("code_id", "bucket", F.concat_ws(" ", *lsh.signature_words()).alias("signature"))


def q_knn_approx(spark, sf_dir):
    idx = lsh.LshIndex.build(fx.search_corpus(spark, sf_dir), LshParams())
    hits = idx.search(fx.search_queries(spark, sf_dir), config.N_RESULTS)
    return rounded(hits.select("query_id", "code_id", "position", "score"))


# ---------------------------------------------------------- run metrics ----
def q_best_checkpoints(spark, sf_dir):
    return rounded(train.best_checkpoints(fx.metric_history(spark, sf_dir)))


def q_early_stop(spark, sf_dir):
    return rounded(train.early_stop(fx.metric_history(spark, sf_dir)))


def q_sweep_trials(spark, sf_dir):
    hist = fx.metric_history(spark, sf_dir)
    trials = train.sweep_trials(hist.select("run_id").distinct())
    return rounded(train.best_trial(trials, hist))


# ------------------------------------------------------------ pipeline ----
def q_prepare_corpus(spark, sf_dir):
    """Q1 with no language filter: splits on disk -> projection -> dense row ids."""
    from lodestar.plans.end_to_end import prepare_corpus
    root = scratch_path(spark, "raw-splits")
    _write_raw_splits(spark, sf_dir, root)
    out = prepare_corpus(spark, root, "python", langs=None)
    return out.select("row_id", "url", "identifier", "split")


def q_prepare_corpus_filtered(spark, sf_dir):
    """Q1 with its language filter through S8: the second run reads the stored corpus."""
    from lodestar.plans.end_to_end import prepare_corpus_once
    root, store = scratch_path(spark, "raw-splits"), scratch_path(spark, "corpus-store")
    _write_raw_splits(spark, sf_dir, root)
    for _ in range(2):
        out = prepare_corpus_once(spark, root, store, "python", list(NL_FILTER), _langid_model(spark, sf_dir), "documents")
    return out.select("row_id", "url", "identifier", "split")


QUERIES_TEXT = {
    "read_pairs_jsonl": q_read_pairs_jsonl,
    "scan_splits": q_scan_splits,
    "corpus_projection": q_corpus_projection,
    "eval_projection": q_eval_projection,
    "project_field": q_project_field,
    "label_intersection": q_label_intersection,
    "corpus_select": q_corpus_select,
    "single_line_docstrings": q_single_line_docstrings,
    "pair_geometry": q_pair_geometry,
    "read_annotations_csv": q_read_annotations_csv,
    "read_queries": q_read_queries,
    "text_stream": q_text_stream,
    "pretokenize": q_pretokenize,
    "word_counts": q_word_counts,
    "alphabet": q_alphabet,
    "bpe_pair_counts": q_bpe_pair_counts,
    "bpe_train": q_bpe_train,
    "bpe_merges": q_bpe_merges,
    "bpe_tokens": q_bpe_tokens,
    "bpe_encode": q_bpe_encode,
    "tokenize_fields": q_tokenize_fields,
    "pluggable_tokenizer": q_pluggable_tokenizer,
    "pad_truncate": q_pad_truncate,
    "embed_lookup": q_embed_lookup,
    "mean_pool": q_mean_pool,
    "nbow_encode": q_nbow_encode,
    "encode_pair": q_encode_pair,
    "encode_with": q_encode_with,
    "batchnorm_stats": q_batchnorm_stats,
    "token_frequency": q_token_frequency,
    "langid_fit": q_langid_fit,
    "langid_predict": q_langid_predict,
    "filter_nl": q_filter_nl,
    "nl_labels": q_nl_labels,
    "index_build": q_index_build,
    "knn_approx": q_knn_approx,
    "best_checkpoints": q_best_checkpoints,
    "early_stop": q_early_stop,
    "sweep_trials": q_sweep_trials,
    "prepare_corpus": q_prepare_corpus,
}


# ------------------------------------------------------- end to end (Q2-Q5) ----
def _stored_pairs(spark, sf_dir, store):
    path = f"{store}/pairs"
    fx.text_pairs(spark, sf_dir).select("row_id", "code", "query").write.parquet(path)
    return spark.read.parquet(path)


def _training(spark, sf_dir):
    """Q2 through the stores: tokenizer and tokens are made once and read back."""
    from lodestar.plans.end_to_end import prepare_training_once
    store = scratch_path(spark, "training-store")
    return prepare_training_once(_stored_pairs(spark, sf_dir, store), store)


def q_prepare_training(spark, sf_dir):
    batched, _ = _training(spark, sf_dir)
    return batched.select("row_id", "split", "batch_id", F.array_join("code_ids", " ").alias("code_ids"),
                          F.array_join("query_ids", " ").alias("query_ids"))


def q_training_batches(spark, sf_dir):
    """Q2 run twice on one store: the second run's batches, which come from the stored tokens."""
    from lodestar.plans.end_to_end import prepare_training_once
    store = scratch_path(spark, "training-store")
    pairs = _stored_pairs(spark, sf_dir, store)
    prepare_training_once(pairs, store)
    batched, _ = prepare_training_once(pairs, store)
    return batched.select("row_id", "split", "batch_id", F.size("code_ids").cast("bigint").alias("code_length"),
                          F.size("query_ids").cast("bigint").alias("query_length"))


def _daily_runs(spark, sf_dir):
    """Runs for the registry: one per event type, an epoch a day, ``valid/loss`` the day's mean value / 100."""
    ev = fx.load(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("run_id"), F.dayofmonth("ts").alias("epoch"))
              .agg((F.avg("value") / 100.0).alias("value"))
              .select("run_id", F.lit("valid").alias("split"), "epoch", F.lit("valid/loss").alias("metric"),
                      F.lit(None).cast("int").alias("step"), "value"))


def q_metrics_sink(spark, sf_dir):
    """All epochs written, then each run's later half again: a rerun replaces its epochs."""
    root = scratch_path(spark, "metrics")
    rows = _daily_runs(spark, sf_dir)
    runs.write_metrics(rows, root)
    runs.write_metrics(rows.where("epoch > 15"), root)
    return rounded(runs.read_metrics(spark, root).select("run_id", "split", F.col("epoch").cast("bigint").alias("epoch"), "metric", "value"))


def q_served_checkpoints(spark, sf_dir):
    """S11 + T3: the epochs that each run of the registry serves, best first."""
    root = scratch_path(spark, "registry")
    rows = _daily_runs(spark, sf_dir)
    runs.write_metrics(rows, root)
    tower = encoder.md5_weights(spark, "shared", 4, 2, 2).checkpoint(eager=True)
    for run, in rows.select("run_id").distinct().collect():             # one row a run
        for epoch in (3, 9, 15, 21, 27):
            runs.save_weights(tower, root, run, epoch)
    runs.publish_best(spark, root)
    return runs.served(spark, root).select("run_id", F.col("epoch").cast("bigint").alias("epoch"), "rank")


def _registry(spark, sf_dir, towers=("shared",)) -> str:
    """A registry with two epochs of one run; the better one is served."""
    root = scratch_path(spark, "registry")
    rows = _daily_runs(spark, sf_dir).where("run_id = 'view'")
    runs.write_metrics(rows, root)
    for epoch in (1, 2):
        weights = [encoder.md5_weights(spark, f"{t}{epoch}" if epoch > 1 else t, config.VOCAB_SIZE, config.EMBEDDING_DIM, config.ENCODING_DIM)
                   .withColumn("param", F.concat(F.lit(t), F.regexp_extract("param", "/.*", 0))) for t in towers]
        runs.save_weights(weights[0] if len(weights) == 1 else weights[0].unionByName(weights[1]), root, "view", epoch)
    runs.publish_best(spark, root, k=1)
    return root


def q_test_mrr(spark, sf_dir):
    """Q3: the best epoch of a stored run on the test pools."""
    from lodestar.plans.end_to_end import test_run
    batched, _ = _training(spark, sf_dir)
    return rounded(test_run(spark, _registry(spark, sf_dir), "view", batched.checkpoint(eager=True)))


def q_validate(spark, sf_dir):
    from lodestar.plans.end_to_end import validate
    batched, _ = _training(spark, sf_dir)
    weights, _ = runs.load_weights(spark, _registry(spark, sf_dir), "view")
    return rounded(validate(batched.checkpoint(eager=True), weights))


def _containment_annotations(spark, sf_dir):
    from lodestar.functions.text import normalize_query
    from lodestar.operators.containment import passages_in_documents
    docs = fx.load(spark, sf_dir, "documents")
    bench = fx.load(spark, sf_dir, "benchmark")
    hits = passages_in_documents(docs, bench)
    return (hits.join(bench, "item_id")
                .select(normalize_query("text").alias("query"), F.col("doc_id").cast("string").alias("url"),
                        F.lit(3.0).alias("relevance"))
                .groupBy("query", "url").agg(F.avg("relevance").alias("relevance")))


def q_passage_annotations(spark, sf_dir):
    return rounded(_containment_annotations(spark, sf_dir))


def q_eval_ndcg(spark, sf_dir):
    """Q4: documents indexed by the code tower of a stored dual run; benchmark passages as queries of its query tower."""
    from lodestar.functions.text import normalize_query
    from lodestar.plans.end_to_end import eval_run
    store = scratch_path(spark, "training-store")
    pairs = _stored_pairs(spark, sf_dir, store)
    model = stores.vocab_once(pairs, store, lambda: bpe.bpe_train(bpe.word_counts(corpus.text_stream(pairs))))
    docs = fx.load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("url"), F.col("text").alias("code"))
    queries = fx.load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), normalize_query("text").alias("query"))
    ann = _containment_annotations(spark, sf_dir)
    return rounded(eval_run(spark, _registry(spark, sf_dir, ("code", "query")), "view", docs, queries, ann, model,
                            index_params=LshParams(), code_tower="code", query_tower="query"))


QUERIES_TEXT.update({
    "prepare_training": q_prepare_training,
    "training_batches": q_training_batches,
    "metrics_sink": q_metrics_sink,
    "served_checkpoints": q_served_checkpoints,
    "prepare_corpus_filtered": q_prepare_corpus_filtered,
    "test_mrr": q_test_mrr,
    "validate": q_validate,
    "passage_annotations": q_passage_annotations,
    "eval_ndcg": q_eval_ndcg,
})


def q_ingest_stream(spark, sf_dir):
    """S1/S2/S8 with Structured Streaming: raw split files -> corpus table, once per file."""
    from lodestar.streaming.ingest import ingest_splits, read_corpus
    root = scratch_path(spark, "raw-stream")
    _write_raw_splits(spark, sf_dir, root)
    sink, ckpt = scratch_path(spark, "corpus-sink"), scratch_path(spark, "corpus-ckpt")
    ingest_splits(spark, root, "python", sink, ckpt)
    return read_corpus(spark, sink).select("url", "identifier", "code", "query", "split")


def q_nbow_fit(spark, sf_dir):
    """E5: two epochs of data-parallel NBOW training; the metric rows it logs."""
    from lodestar.operators.fit import nbow_fit
    from lodestar.plans.end_to_end import validate
    batched, _ = _training(spark, sf_dir)
    batched = batched.checkpoint(eager=True)

    def validate_fn(weights):
        r = validate(batched, weights).first()
        return r["valid_loss"], r["valid_mrr"]

    _, metrics = nbow_fit(batched, epochs=2, batches_per_step=8, validate_fn=validate_fn)
    df = spark.createDataFrame(metrics, "run_id string, split string, epoch int, metric string, value double")
    return rounded(df)


QUERIES_TEXT.update({"ingest_stream": q_ingest_stream, "nbow_fit": q_nbow_fit})


def q_path_layout(spark, sf_dir):
    """Per source, its language set as the nl directory and the model path."""
    from lodestar.functions.text import capitalize, format_path, nl_key
    docs = fx.load(spark, sf_dir, "documents")
    per = docs.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))   # <= #languages each
    return per.select("source", nl_key("langs").alias("nl_dir"),
                      format_path("data/%s/%s", "source", nl_key("langs")).alias("model_dir"),
                      capitalize("source").alias("source_cap"))


def q_run_names(spark, sf_dir):
    """Run ids ``yyMMdd_HHmm`` from each run's first event time."""
    from lodestar.functions.text import run_id
    ev = fx.load(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(run_id(F.min("ts")).alias("run_id"))


def q_search(spark, sf_dir):
    """K4/K5: benchmark passages searched against the documents through a bound searcher."""
    from lodestar.functions.text import normalize_query
    from lodestar.operators.search import Searcher
    model = _bpe_model(spark, sf_dir)
    w, _ = runs.load_weights(spark, _registry(spark, sf_dir), "view")
    docs = fx.load(spark, sf_dir, "documents")
    code = bpe.bpe_encode(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("code")),
                          "code", model, config.CODE_LENGTH, "ids")
    vectors = encoder.nbow_encode(code, "ids", w).withColumnRenamed("row_id", "code_id")
    lookup = docs.select(F.col("doc_id").alias("code_id"), F.col("doc_id").cast("string").alias("url"))

    def encode_queries(qdf):
        tok = bpe.bpe_encode(qdf.withColumnRenamed("query_id", "row_id"), "query", model, config.QUERY_LENGTH, "ids")
        return encoder.nbow_encode(tok, "ids", w).withColumnRenamed("row_id", "query_id")

    searcher = Searcher(vectors, lookup, encode_queries)
    queries = fx.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                         normalize_query("text").alias("query"))
    return searcher.search(queries, config.N_RESULTS).select("query_id", "url", "position")


QUERIES_TEXT.update({"path_layout": q_path_layout, "run_names": q_run_names, "search": q_search})


def _word_batched(spark, sf_dir, split_name: str, pool: int):
    """Q2 with the word-vocabulary tokenizer: tokens, exact split, pools in split order."""
    pairs = fx.text_pairs(spark, sf_dir)
    vocab = _word_vocab(spark, sf_dir)
    tok = bpe.word_encode(bpe.word_encode(pairs, "code", vocab, config.CODE_LENGTH, "code_ids"),
                          "query", vocab, config.QUERY_LENGTH, "query_ids")
    split = rowid.split_80_10_10(tok.select("row_id", "code_ids", "query_ids"))
    return rowid.assign_batches(split.where(F.col("split") == split_name), pool, "split_pos")


def q_test_mrr_words(spark, sf_dir):
    """Q3 end to end with a pluggable (word-vocabulary) tokenizer: test pools of 1000 -> MRR."""
    from lodestar.plans.end_to_end import test_mrr
    batched = _word_batched(spark, sf_dir, "test", config.MRR_POOL)
    return rounded(test_mrr(batched, _weights(spark)))


def q_validate_words(spark, sf_dir):
    """Q5 end to end with the word-vocabulary tokenizer: valid pools of 10 -> loss, MRR."""
    from lodestar.plans.end_to_end import validate
    batched = _word_batched(spark, sf_dir, "valid", config.BATCH_SIZE)
    return rounded(validate(batched, _weights(spark)))


QUERIES_TEXT.update({"test_mrr_words": q_test_mrr_words, "validate_words": q_validate_words})

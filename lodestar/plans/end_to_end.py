"""End-to-end flows (Q1-Q5), each a chain of the library's DataFrame operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import config
from lodestar.functions.text import strip_newlines
from lodestar.operators import bpe, corpus, encoder, langid, relevance, rowid, scoring, search
from lodestar.sources import files, runs, stores


def prepare_corpus(spark: SparkSession, root: str, code_lang: str, langs: Sequence[str] | None = None,
                   langid_model: DataFrame | None = None, predicate: Column | None = None,
                   threshold: float = config.LANGID_THRESHOLD) -> DataFrame:
    """Q1: S2 -> P4 -> P1 -> G1.

    Reads every split directory in one scan, optionally keeps rows whose
    docstring (newlines as spaces) is identified as one of ``langs``, projects
    to ``url, identifier, code, query`` and numbers rows densely in
    (split order, url) order.
    """
    raw = files.scan_splits(spark, root, code_lang)
    if predicate is not None:
        raw = raw.where(predicate)
    if langs:
        if langid_model is None:
            raise ValueError("a language filter needs a fitted language model")
        documents = corpus.corpus_projection(raw.withColumn("_doc", strip_newlines("docstring")), "_doc")     # the token lists go no further
        pred = langid.langid_predict(documents, langid_model, "_doc", None)
        projected = langid.filter_nl(pred, langs, threshold).drop("_doc", "lang_pred", "lang_prob")
    else:
        projected = corpus.corpus_projection(raw)
    return rowid.global_row_id(projected, ["split_order", "url"], "row_id")


def prepare_corpus_once(spark: SparkSession, root: str, store: str, code_lang: str, langs: Sequence[str] | None = None,
                        langid_model: DataFrame | None = None, model_name: str | None = None,
                        threshold: float = config.LANGID_THRESHOLD) -> DataFrame:
    """Q1 through S8: built when ``store`` has no corpus for these raw files and parameters, else only read.

    ``model_name`` stands for the language model in the key: give each model its own.
    """
    if langs and not model_name:
        raise ValueError("a stored, filtered corpus needs the name of its language model")
    key = stores.input_key([files.scan_splits(spark, root, code_lang)], kind="corpus", code_lang=code_lang,
                           langs=sorted(langs or []), model=model_name, threshold=threshold)
    return stores.materialize_once(spark, store, "corpus", key,
                                   lambda: prepare_corpus(spark, root, code_lang, langs, langid_model, threshold=threshold))


def batches(tokens: DataFrame, batch_size: int = config.BATCH_SIZE, epoch: int = 0) -> DataFrame:
    """T2 split -> T1 order -> W3 batches (train shuffled per epoch, valid in order, test in pools of 1 + distractors).

    Numbered on the ids alone; the token arrays join once at the end.
    """
    shuffled = rowid.shuffle_rows(rowid.split_80_10_10(tokens.select("row_id")), epoch)
    pos = F.when(F.col("split") == "train", F.col("shuffle_pos")).otherwise(F.col("split_pos"))
    size = F.when(F.col("split") == "test", F.lit(config.MRR_POOL)).otherwise(F.lit(batch_size))
    return tokens.join(shuffled.withColumn("batch_id", F.floor(pos / size).cast("bigint")), "row_id")


def prepare_training(pairs: DataFrame, model: bpe.BpeModel | None = None,
                     batch_size: int = config.BATCH_SIZE, epoch: int = 0) -> tuple[DataFrame, bpe.BpeModel]:
    """Q2: tokenizer (trained on code and query text when not given) -> B5 -> split and batches."""
    if model is None:
        model = bpe.bpe_train(bpe.word_counts(corpus.text_stream(pairs)))
    return batches(bpe.tokenize_fields(pairs, model), batch_size, epoch), model


def prepare_training_once(pairs: DataFrame, store: str, batch_size: int = config.BATCH_SIZE,
                          epoch: int = 0) -> tuple[DataFrame, bpe.BpeModel]:
    """Q2 through S9 and S7: tokenizer and tokens of a stored corpus are made once; a second run reads neither texts nor words.

    ``pairs`` must be a plain scan of files (``row_id, code, query``).
    """
    model = stores.vocab_once(pairs, store, lambda: bpe.bpe_train(bpe.word_counts(corpus.text_stream(pairs))),
                              size=config.VOCAB_SIZE, min_count=config.VOCAB_MIN_COUNT)
    return batches(stores.token_cache(pairs, store, model), batch_size, epoch), model


def _encoded_pairs(batched: DataFrame, weights: DataFrame, shared: bool) -> DataFrame:
    return encoder.encode_pair(batched.select("row_id", "code_ids", "query_ids", "split", "batch_id"), weights, shared)


def test_run(spark: SparkSession, registry: str, run_id: str, batched: DataFrame, shared: bool = True) -> DataFrame:
    """Q3 of a stored run: its best checkpoint is loaded and ``test/mrr`` goes to the metric sink."""
    weights, epoch = runs.load_weights(spark, registry, run_id)
    result = test_mrr(batched, weights, shared).checkpoint(eager=True)
    runs.log_metrics(spark, registry, run_id, epoch, {"test/mrr": result.first()["mrr"]})
    return result.withColumn("epoch", F.lit(epoch))


def eval_run(spark: SparkSession, registry: str, run_id: str, corpus_df: DataFrame, queries: DataFrame, annotations: DataFrame,
             model: bpe.BpeModel, **options) -> DataFrame:
    """Q4 of a stored run: its best checkpoint is loaded and both NDCG values go to the metric sink."""
    weights, epoch = runs.load_weights(spark, registry, run_id)
    result = eval_ndcg(corpus_df, queries, annotations, model, weights, **options).checkpoint(eager=True)
    found = result.first()
    runs.log_metrics(spark, registry, run_id, epoch, {f"eval/{k}": found[k] for k in ("ndcg_within", "ndcg_all")})
    return result.withColumn("epoch", F.lit(epoch))


def test_mrr(batched: DataFrame, weights: DataFrame, shared: bool = True) -> DataFrame:
    """Q3: test split -> encode -> in-pool scores (pools of 1000) -> MRR."""
    enc = _encoded_pairs(batched.where(F.col("split") == "test"), weights, shared)
    scores = scoring.batch_query_scores(enc)
    return scoring.mrr(scores).withColumn("pool_size", F.lit(config.MRR_POOL).cast("bigint"))


def validate(batched: DataFrame, weights: DataFrame, shared: bool = True) -> DataFrame:
    """Q5: valid split -> encode -> per-batch loss and MRR -> epoch means."""
    enc = _encoded_pairs(batched.where(F.col("split") == "valid"), weights, shared)
    scores = scoring.batch_query_scores(enc)
    # the epoch mean of batch losses weighted by batch size is the mean per-query loss
    return scores.agg(F.avg(F.lit(1.0) - F.col("target_score") + F.col("hardest_negative")).alias("valid_loss"),
                      F.avg(F.lit(1.0) / F.col("rank")).alias("valid_mrr"),
                      F.count(F.lit(1)).alias("n_queries"))


def eval_ndcg(corpus_df: DataFrame, queries: DataFrame, annotations: DataFrame, model: bpe.BpeModel,
              weights: DataFrame, index_params=None, n_results: int = config.N_RESULTS,
              code_tower: str = "shared", query_tower: str = "shared") -> DataFrame:
    """Q4: corpus code -> tokens -> vectors -> index; queries -> tokens -> vectors
    -> top-n -> urls; NDCG (within and all) against the annotations.

    ``corpus_df``: ``(row_id, url, code)``; ``queries``: ``(query_id, query)``;
    ``annotations``: ``(query, url, relevance)`` with normalised queries. Code
    and queries are encoded by their own towers (both ``shared`` for a single one).
    """
    from lodestar.operators.lsh import LshIndex
    code_tok = bpe.bpe_encode(corpus_df, "code", model, config.CODE_LENGTH, "ids")
    code_vec = encoder.nbow_encode(code_tok, "ids", weights, code_tower, "row_id", "vec")
    q_tok = bpe.bpe_encode(queries, "query", model, config.QUERY_LENGTH, "ids")
    q_vec = encoder.nbow_encode(q_tok.withColumnRenamed("query_id", "row_id"), "ids", weights, query_tower,
                                "row_id", "vec").withColumnRenamed("row_id", "query_id")
    vectors = code_vec.withColumnRenamed("row_id", "code_id")
    if index_params is not None:
        hits = LshIndex.build(vectors, index_params).search(q_vec, n_results)
    else:
        hits = search.knn_exact(q_vec, vectors, n_results)
    lookup = corpus_df.select(F.col("row_id").alias("code_id"), "url")
    preds = (search.resolve_urls(hits, lookup)
             .join(queries.select("query_id", F.lower(F.col("query")).alias("query")), "query_id")
             .select("query", "url", "position", "query_id"))
    # Of queries with the same text the later one's results stand
    return relevance.ndcg_both(relevance.merge_batch_predictions(preds, "query_id"), annotations)

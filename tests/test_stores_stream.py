"""Build-once stores, the run registry and the metric sink; streaming ingest reads each raw file once."""
import pytest
from pyspark.sql import functions as F

from lodestar.operators import bpe
from lodestar.operators.encoder import md5_weights
from lodestar.plans import end_to_end
from lodestar.session import scratch_path
from lodestar.sources import files, runs, stores
from lodestar.streaming.ingest import ingest_splits, read_corpus


def _stored_pairs(spark, n=40):
    path = scratch_path(spark, "t-pairs")
    rows = [(i, f"def f{i} return the value of x", f"the value {i}") for i in range(n)]
    spark.createDataFrame(rows, "row_id long, code string, query string").write.parquet(path)
    return path


def test_a_key_is_built_once_and_names_its_inputs(spark):
    root, path, calls = scratch_path(spark, "t-store"), _stored_pairs(spark), []

    def build():
        calls.append(1)
        return spark.range(5)

    key = stores.input_key([spark.read.parquet(path)], length=200)
    for _ in range(2):
        assert stores.materialize_once(spark, root, "t", key, build).count() == 5
    assert len(calls) == 1
    assert stores.input_key([spark.read.parquet(path)], length=30) != key
    assert stores.input_key([spark.read.parquet(path)], length=200) == key
    spark.createDataFrame([(99, "new", "row")], "row_id long, code string, query string").write.mode("append").parquet(path)
    assert stores.input_key([spark.read.parquet(path)], length=200) != key          # a file more


def test_a_crash_before_publishing_leaves_nothing_to_read(spark):
    root = scratch_path(spark, "t-store")

    def write_and_die(folder):
        spark.range(3).write.parquet(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stores.build_folder(spark, root, "t", "key", write_and_die)
    assert not stores.path_exists(spark, f"{root}/t/key")
    assert stores.materialize_once(spark, root, "t", "key", lambda: spark.range(7)).count() == 7


def test_the_second_of_two_writers_reads_the_first_ones(spark):
    root = scratch_path(spark, "t-store")

    def slow(folder):
        stores.materialize_once(spark, root, "t", "key", lambda: spark.range(1))      # another writer publishes meanwhile
        spark.range(2).write.parquet(folder)

    path = stores.build_folder(spark, root, "t", "key", slow)
    assert spark.read.parquet(path).count() == 1
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/t")
    left = [s.getPath().getName() for s in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)]
    assert left == ["key"]


def test_second_training_run_reads_no_corpus(spark, monkeypatch):
    path, store = _stored_pairs(spark), scratch_path(spark, "t-store")
    pairs = spark.read.parquet(path)
    first, model = end_to_end.prepare_training_once(pairs, store, batch_size=4)
    monkeypatch.setattr(bpe, "bpe_train", lambda *a, **k: pytest.fail("trained again"))
    monkeypatch.setattr(bpe, "tokenize_fields", lambda *a, **k: pytest.fail("tokenized again"))
    second, again = end_to_end.prepare_training_once(spark.read.parquet(path), store, batch_size=4)
    assert again.vocab == model.vocab and again.merges == model.merges
    assert sorted(map(str, second.collect())) == sorted(map(str, first.collect()))
    assert not any(path.rstrip("/") in f for f in second.inputFiles())
    assert path.rstrip("/") not in second._jdf.queryExecution().executedPlan().toString()


def test_second_corpus_run_reads_no_raw_files(spark):
    root, store = scratch_path(spark, "t-raw"), scratch_path(spark, "t-store")
    rows = [(f"u{i}", "f", ["x", str(i)], ["d"], "doc") for i in range(6)]
    for split in ("train", "valid", "test"):
        files.write_jsonl(spark.createDataFrame(rows, files.RAW_SCHEMA), files.split_dir(root, "python", split))
    first = end_to_end.prepare_corpus_once(spark, root, store, "python")
    second = end_to_end.prepare_corpus_once(spark, root, store, "python")
    assert second.count() == 18 and sorted(first.inputFiles()) == sorted(second.inputFiles())
    assert "/final/jsonl/" not in second._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        end_to_end.prepare_corpus_once(spark, root, store, "python", ["english"])


def test_vocab_round_trip(spark):
    m = bpe.BpeModel({"[PAD]": 0, "[UNK]": 1, "a": 2, "b": 3, "ab": 4}, [(2, 3, 4)])
    p = scratch_path(spark, "t-vocab")
    stores.save_vocab(m, spark, p)
    back = stores.load_vocab(spark, p)
    assert back.vocab == m.vocab and back.merges == m.merges


def test_two_writes_of_an_epoch_leave_one_row(spark):
    root = scratch_path(spark, "t-metrics")
    assert runs.read_metrics(spark, root).count() == 0
    for value in (0.5, 0.4):
        runs.log_metrics(spark, root, "r1", 1, {"valid/loss": value, "valid/mrr": 0.1})
    runs.log_metrics(spark, root, "r1", 2, {"valid/loss": 0.3})
    runs.log_metrics(spark, root, "r1", 1, {"test/mrr": 0.9})
    got = {(r["epoch"], r["metric"]): r["value"] for r in runs.read_metrics(spark, root).collect()}
    assert got == {(1, "valid/loss"): 0.4, (1, "valid/mrr"): 0.1, (2, "valid/loss"): 0.3, (1, "test/mrr"): 0.9}
    with pytest.raises(ValueError):
        runs.log_metrics(spark, root, "r1", 3, {"loss": 1.0})


def test_registry_serves_the_best_epochs_and_drops_the_others(spark):
    root = scratch_path(spark, "t-registry")
    weights = md5_weights(spark, "shared", 10, 3, 2)
    with pytest.raises(LookupError):
        runs.load_weights(spark, root, "r1")
    for epoch, loss in ((1, 0.5), (2, 0.2), (3, float("nan")), (4, 0.3), (5, 0.1)):
        runs.save_weights(weights.withColumn("row", F.col("row") + epoch), root, "r1", epoch)
        runs.log_metrics(spark, root, "r1", epoch, {"valid/loss": loss})
    runs.save_weights(weights, root, "r2", 7)                       # no loss yet: not served
    runs.publish_best(spark, root, k=2)
    got, epoch = runs.load_weights(spark, root, "r1")
    assert epoch == 5 and got.count() == weights.count() and got.agg(F.min("row")).first()[0] == 5
    assert runs.load_weights(spark, root, "r1", rank=2)[1] == 2
    assert {r["epoch"] for r in runs._saved(spark, root).collect()} == {2, 5}
    for rank, run in ((3, "r1"), (1, "r2")):
        with pytest.raises(LookupError):
            runs.load_weights(spark, root, run, rank)


def test_a_crash_before_the_pointer_swap_keeps_the_old_choice(spark, monkeypatch):
    root = scratch_path(spark, "t-registry")
    weights = md5_weights(spark, "shared", 10, 3, 2)
    for epoch, loss in ((1, 0.5), (2, 0.2)):
        runs.save_weights(weights, root, "r1", epoch)
        runs.log_metrics(spark, root, "r1", epoch, {"valid/loss": loss})
        if epoch == 1:
            runs.publish_best(spark, root, k=1)
    with monkeypatch.context() as patched:
        patched.setattr(runs, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            runs.publish_best(spark, root, k=1)
    assert runs.load_weights(spark, root, "r1")[1] == 1
    runs.publish_best(spark, root, k=1)
    assert runs.load_weights(spark, root, "r1")[1] == 2


def test_stream_ingest_is_incremental(spark):
    root = scratch_path(spark, "t-raw")
    rows = [(f"u{i}", "f", ["x", str(i)], ["d"], "doc") for i in range(6)]
    df = spark.createDataFrame(rows, files.RAW_SCHEMA)
    files.write_jsonl(df.limit(3), files.split_dir(root, "python", "train"))
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    ingest_splits(spark, root, "python", sink, ckpt)
    assert read_corpus(spark, sink).count() == 3
    files.write_jsonl(df.where(F.col("url").isin("u3", "u4", "u5")), files.split_dir(root, "python", "test"))
    ingest_splits(spark, root, "python", sink, ckpt)
    out = read_corpus(spark, sink)
    assert out.count() == 6
    assert {r["split"] for r in out.where(F.col("url") == "u4").collect()} == {"test"}

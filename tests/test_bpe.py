"""BPE training/encoding against the public tokenizers package on toy strings and F1."""
import tracemalloc

import numpy as np
import pytest

from lodestar.operators import bpe

tokenizers = pytest.importorskip("tokenizers")


def _hf(texts, vocab_size, min_freq):
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer
    tok = Tokenizer(BPE(unk_token="[UNK]"))
    tok.pre_tokenizer = Whitespace()
    tok.train_from_iterator(texts, BpeTrainer(vocab_size=vocab_size, min_frequency=min_freq,
                                              special_tokens=["[PAD]", "[UNK]"], show_progress=False))
    return tok


@pytest.mark.parametrize("texts,vs,mf", [(["ab ab cd cd xy"], 20, 1), (["aaaa aaaa aaa"], 20, 1),
                                         (["the then there these those", "them theme"] * 3, 40, 2)])
def test_train_matches_reference_tokenizer(spark, texts, vs, mf):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    wc = bpe.word_counts(df)
    full = bpe.bpe_train(wc, vs, mf)
    assert full.vocab == _hf(texts, vs, mf).get_vocab()
    narrow = bpe.bpe_train(wc, vs, mf, top_pairs=4, speculate_words=2, speculate_steps=3)     # poor guesses
    assert narrow.vocab == full.vocab and narrow.merges == full.merges


def test_encode_matches_and_unknown_chars(spark):
    texts = ["the then there these those", "them theme"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = bpe.bpe_train(bpe.word_counts(df), 40, 2)
    hf = _hf(texts, 40, 2)
    probe = spark.createDataFrame([(0, "these themes"), (1, "zzz the"), (2, "")], "row_id long, text string")
    got = {r["row_id"]: r["ids"] for r in bpe.bpe_encode(probe, "text", model, None).collect()}
    assert got[0] == hf.encode("these themes").ids
    assert got[1][:3] == [1, 1, 1]          # each unknown character is its own UNK
    assert got[2] == []
    padded = {r["row_id"]: r["ids"] for r in bpe.bpe_encode(probe, "text", model, 4).collect()}
    assert all(len(v) == 4 for v in padded.values()) and padded[2] == [0, 0, 0, 0]


def test_f1_vocab_equals_reference(spark):
    from pyspark.sql import functions as F

    from lodestar.plans import fixtures as fx
    from tests.conftest import SF001
    pairs = fx.text_pairs(spark, SF001)
    stream = pairs.select(F.explode(F.array("code", "query")).alias("text"))
    texts = [r["text"] for r in stream.collect()]
    assert bpe.bpe_train(bpe.word_counts(stream)).vocab == _hf(texts, 5000, 10).get_vocab()


def test_f1_rounds_do_not_depend_on_the_speculation(spark):
    """Many merges a round, and the same ones when the guesses are poor."""
    from pyspark.sql import functions as F

    from lodestar.plans import fixtures as fx
    from tests.conftest import SF001
    stream = fx.text_pairs(spark, SF001).select(F.explode(F.array("code", "query")).alias("text"))
    wc = bpe.word_counts(stream).checkpoint(eager=True)
    rounds = []
    full = bpe.bpe_train(wc, progress=lambda r, m, v: rounds.append(r))
    assert rounds and rounds[-1] < len(full.merges) / 20
    narrow = bpe.bpe_train(wc, top_pairs=256, speculate_words=300, speculate_steps=128)
    assert narrow.vocab == full.vocab and narrow.merges == full.merges


def test_training_does_not_depend_on_the_arrow_setting(spark):
    """A session without Arrow collection hands lists, not numpy arrays, to the driver."""
    wc = bpe.word_counts(spark.createDataFrame([("the then there these those them theme",)] * 3, "text string"))
    setting = "spark.sql.execution.arrow.pyspark.enabled"
    models = []
    for on in ("true", "false"):
        before = spark.conf.get(setting)
        spark.conf.set(setting, on)
        try:
            models.append(bpe.bpe_train(wc, 40, 2))
        finally:
            spark.conf.set(setting, before)
    assert models[0].merges and models[0].merges == models[1].merges and models[0].vocab == models[1].vocab


def test_f5_the_driver_holds_words_and_deltas_as_numbers():
    """Rows arrive one by one: lists of words and tuples of deltas took most of the driver's memory."""
    rng = np.random.default_rng(5)
    words = ((rng.integers(300, 330, 12).tolist(), 1) for _ in range(20_000))
    tokens = [chr(0x4E00 + i) for i in range(330)]
    tracemalloc.start()
    seq = bpe._speculate(words, {t: i for i, t in enumerate(tokens)}, tokens, 3, 1)
    speculated = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tracemalloc.start()
    deltas = bpe._by_step((j % 7, j, j + 1, -j) for j in range(100_000))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [n for _, _, n in seq] == [330, 331, 332] and speculated < 20_000 * 800
    assert held < 100_000 * 150
    assert deltas[3][:2].tolist() == [[3, 4, -3], [10, 11, -10]] and sum(map(len, deltas.values())) == 100_000


def test_f5_rounds_are_few_when_most_words_are_rare(spark):
    """Rare words decide most merges: all of them count in the driver's sequence, which a round keeps whole."""
    rng = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnop"))
    words = {"".join(rng.choice(letters, n, p=np.arange(16, 0, -1) / 136)) for n in rng.integers(2, 9, 3_000)}
    wc = spark.createDataFrame([(w, 1 + (i % 50 == 0)) for i, w in enumerate(sorted(words))], "word string, cnt long")
    rounds = []
    model = bpe.bpe_train(wc, 150, 2, speculate_words=500, progress=lambda r, m, v: rounds.append(m))
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", *letters])}
    tokens, rows = list(vocab), wc.collect()
    merges = bpe._merge_loop([[vocab[c] for c in r["word"]] for r in rows], [r["cnt"] for r in rows], vocab, tokens, 150, 2)
    assert model.merges == merges and model.vocab == vocab
    assert len(merges) == 132 and len(rounds) <= 30, rounds

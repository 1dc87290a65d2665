"""Fixed values that must equal the reference's configuration.

These are settings, not logic: seed, split fractions, vocabulary and sequence
sizes, early-stopping thresholds, pool sizes and the sweep search space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values (reference configuration) ---------------------------------
SEED = 123456
DATA_SPLITS = (0.8, 0.1, 0.1)          # train, valid, test
VOCAB_SIZE = 5000
VOCAB_MIN_COUNT = 10
SPECIAL_TOKENS = ("[PAD]", "[UNK]")    # ids 0 and 1
PAD_ID = 0
UNK_ID = 1
CODE_LENGTH = 200
QUERY_LENGTH = 30
EARLY_STOP_MIN_DELTA = 0.0005
EARLY_STOP_PATIENCE = 5
MRR_DISTRACTORS = 999                  # test pool = 1 + distractors
BATCH_SIZE = 10
TINY_SIZE = 5000
N_RESULTS = 100
N_TREES = 200
EMBEDDING_DIM = 128
ENCODING_DIM = 128
ENCODER_DROPOUT = 0.1
LEARNING_RATE = 0.1
BATCHNORM_EPS = 1e-5
CODE_LANGUAGES = ("python", "javascript", "java", "ruby", "php", "go")
SPLIT_NAMES = ("train", "valid", "test")
DEFAULT_NL_DIR = "all"
LANGID_THRESHOLD = 0.5

# Sweep search space (random search): log-uniform rate exp(U(-8, -1)),
# uniform clip [0.8, 1.6], uniform dropout [0, 0.5], dimension choices.
SWEEP_LOG_LR = (-8.0, -1.0)
SWEEP_CLIP = (0.80, 1.60)
SWEEP_DROPOUT = (0.00, 0.50)
SWEEP_DIMS = (16, 32, 64, 128)

# Metric names written to the metrics table.
METRIC_NAMES = ("train/batch_loss", "train/loss", "valid/loss", "valid/mrr",
                "test/mrr", "eval/ndcg_within", "eval/ndcg_all")
# -----------------------------------------------------------------------------

MRR_POOL = MRR_DISTRACTORS + 1


@dataclass(frozen=True)
class LshParams:
    """Signed-random-projection index parameters (stand-in for the tree count)."""
    n_bits: int = 256          # bits of a vector's signature; the first ones number its bucket
    bucket_rows: int = 32      # mean codes of a bucket: sets the depth from the corpus size
    margin: float = 2.5        # a bit whose margin (in standard units) is larger is never probed both ways
    n_probes: int = 1024       # buckets a query visits at most, nearest first
    oversample: float = 1.5    # codes scored exactly: oversample * sqrt(k * corpus)
    seed: int = SEED
    chunk_rows: int = 4096     # codes of one kernel call
    tile_rows: int = 4096      # queries of one kernel call


@dataclass(frozen=True)
class EncoderParams:
    vocab_size: int = VOCAB_SIZE
    embedding_dim: int = EMBEDDING_DIM
    encoding_dim: int = ENCODING_DIM
    dropout: float = ENCODER_DROPOUT
    extra: dict = field(default_factory=dict)

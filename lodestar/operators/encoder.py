"""Encoder inference as Arrow-batched numpy kernels.

Weights live in a long table ``weights(param, row, values ARRAY<DOUBLE>)``.
Parameter names are ``{tower}/{name}`` with names ``embed`` (V x D, row 0 is
the zero pad row), ``fc_weight`` (H x D), ``fc_bias``, ``bn_mean``,
``bn_var``, ``bn_weight``, ``bn_bias`` (one row of H values each).

The weight table is model-sized (bounded by V*D + H*D + 5H values); it is
counted, then shipped once per executor as a broadcast. Encoding is a narrow
``mapInPandas`` over the rows, in the partitions they arrive in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lodestar import config
from lodestar.functions.text import hash_uniform
from lodestar.session import ship_package

PARAM_NAMES = ("embed", "fc_weight", "fc_bias", "bn_mean", "bn_var", "bn_weight", "bn_bias")
MAX_WEIGHT_VALUES = 50_000_000       # refuse to broadcast a model larger than this
_STATE_VALUES = 1 << 21              # token states (rows x length x dims) that a kernel holds at once


def md5_weights(spark: SparkSession, tower: str, vocab_size: int, embedding_dim: int,
                encoding_dim: int) -> DataFrame:
    """Deterministic weights: value = ``(u - 0.5) * 2`` with ``u`` the md5
    uniform of ``'{tower}/{name}:{row}:{dim}'``; ``bn_var`` = ``u + 0.5``;
    the pad row of ``embed`` is zero. Generated as one Spark job.
    """
    shapes = {"embed": (vocab_size, embedding_dim), "fc_weight": (encoding_dim, embedding_dim),
              "fc_bias": (1, encoding_dim), "bn_mean": (1, encoding_dim), "bn_var": (1, encoding_dim),
              "bn_weight": (1, encoding_dim), "bn_bias": (1, encoding_dim)}
    frames = []
    for name, (rows, dims) in shapes.items():
        param = f"{tower}/{name}"
        cells = (spark.range(rows * dims)
                      .select((F.col("id") / dims).cast("int").alias("row"), (F.col("id") % dims).cast("int").alias("dim")))
        u = hash_uniform(F.concat_ws(":", F.lit(param), F.col("row").cast("string"), F.col("dim").cast("string")))
        if name == "bn_var":
            v = u + F.lit(0.5)
        elif name == "embed":
            v = F.when(F.col("row") == 0, F.lit(0.0)).otherwise((u - F.lit(0.5)) * F.lit(2.0))
        else:
            v = (u - F.lit(0.5)) * F.lit(2.0)
        frames.append(cells.select(F.lit(param).alias("param"), "row", "dim", v.alias("value")))
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    return (long.groupBy("param", "row")
                .agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("cells"))
                .select("param", "row", F.col("cells.value").alias("values")))


def weights_long(weights: DataFrame) -> DataFrame:
    """``(param, row, dim, value)`` form of a weight table (the SQL-oracle shape)."""
    return weights.select("param", "row", F.posexplode("values").alias("dim", "value"))


class Tower:
    """Numpy view of one tower's parameters."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.embed = params["embed"]
        self.fc_w = params["fc_weight"]
        self.fc_b = params["fc_bias"][0]
        self.bn_mean = params["bn_mean"][0]
        self.bn_var = params["bn_var"][0]
        self.bn_w = params["bn_weight"][0]
        self.bn_b = params["bn_bias"][0]

    def pool(self, ids: np.ndarray) -> np.ndarray:
        """Mean over the padded length L (pad rows are zero vectors)."""
        out = np.empty((len(ids), self.embed.shape[1]))
        for rows in _row_slices(ids, self.embed.shape[1]):
            out[rows] = self.embed[ids[rows]].sum(axis=1) / ids.shape[1]
        return out

    def head(self, pooled: np.ndarray) -> np.ndarray:
        """linear -> batch norm (stored statistics) -> tanh; dropout is off."""
        h = pooled @ self.fc_w.T + self.fc_b
        h = (h - self.bn_mean) / np.sqrt(self.bn_var + config.BATCHNORM_EPS) * self.bn_w + self.bn_b
        return np.tanh(h)

    def encode(self, ids: np.ndarray) -> np.ndarray:
        return self.head(self.pool(ids))


def load_towers(weights: DataFrame) -> dict[str, Tower]:
    """Collect a (size-checked) weight table into numpy towers by prefix."""
    n_values = weights.select(F.sum(F.size("values"))).first()[0] or 0
    if n_values > MAX_WEIGHT_VALUES:
        raise ValueError(f"weight table has {n_values} values, above the broadcast bound")
    by_param: dict[str, dict[int, list[float]]] = {}
    for r in weights.collect():
        by_param.setdefault(r["param"], {})[int(r["row"])] = r["values"]
    towers: dict[str, dict[str, np.ndarray]] = {}
    for param, rows in by_param.items():
        tower, name = param.rsplit("/", 1)
        mat = np.zeros((max(rows) + 1, len(next(iter(rows.values())))))
        for i, v in rows.items():
            mat[i] = v
        towers.setdefault(tower, {})[name] = mat
    return {t: Tower(p) for t, p in towers.items()}


def _row_slices(ids: np.ndarray, dim: int) -> list[slice]:
    """Rows of a (B, L) batch in slices of at most ``_STATE_VALUES`` values of (rows, L, dim), one row at least."""
    step = max(1, _STATE_VALUES // max(1, ids.shape[1] * dim))
    return [slice(a, a + step) for a in range(0, len(ids), step)]


def _ids_matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in col]) if len(col) else np.zeros((0, 0), np.int64)


def _encode_frame(df: DataFrame, ids_col: str, tower: str, weights: DataFrame, id_col: str,
                  out_col: str, stage: str) -> DataFrame:
    ship_package(df.sparkSession)
    towers = load_towers(weights)
    if tower not in towers:
        raise KeyError(f"no weights for tower {tower!r}")
    bc = df.sparkSession.sparkContext.broadcast(towers[tower])

    def kernel(batches):
        t = bc.value
        for pdf in batches:
            ids = _ids_matrix(pdf[ids_col])
            if len(pdf) == 0:
                continue
            out = t.pool(ids) if stage == "pool" else t.encode(ids)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(dtype=np.int64), out_col: list(out)})

    return df.select(id_col, ids_col).mapInPandas(kernel, f"{id_col} long, {out_col} array<double>")


def nbow_encode(df: DataFrame, ids_col: str, weights: DataFrame, tower: str = "shared",
                id_col: str = "row_id", out_col: str = "vec") -> DataFrame:
    """``tanh(BN(W * mean(embed[ids]) + b))`` per row."""
    return _encode_frame(df, ids_col, tower, weights, id_col, out_col, "encode")


def mean_pool(df: DataFrame, ids_col: str, weights: DataFrame, tower: str = "shared",
              id_col: str = "row_id", out_col: str = "pooled") -> DataFrame:
    """The pooled embedding (divisor = padded length)."""
    return _encode_frame(df, ids_col, tower, weights, id_col, out_col, "pool")


def encode_pair(df: DataFrame, weights: DataFrame, shared: bool = True, id_col: str = "row_id",
                code_ids: str = "code_ids", query_ids: str = "query_ids") -> DataFrame:
    """Siamese (one ``shared`` tower) or dual (``code`` and ``query`` towers).

    Returns the frame with ``code_vec, query_vec`` in place of the ids, from one narrow pass (both sides of
    a row are encoded together and other columns pass through, so nothing is joined back); queries always use
    the query tower in the dual model.
    """
    ship_package(df.sparkSession)
    code_tower, query_tower = ("shared", "shared") if shared else ("code", "query")
    towers = load_towers(weights)
    for t in {code_tower, query_tower}:
        if t not in towers:
            raise KeyError(f"no weights for tower {t!r}")
    bc = df.sparkSession.sparkContext.broadcast({t: towers[t] for t in {code_tower, query_tower}})

    def kernel(batches):
        tw = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            c = tw[code_tower].encode(_ids_matrix(pdf[code_ids]))
            q = tw[query_tower].encode(_ids_matrix(pdf[query_ids]))
            yield pdf[carried].assign(code_vec=list(c), query_vec=list(q))

    carried = [c for c in df.columns if c not in (code_ids, query_ids)]
    vectors = ArrayType(DoubleType())
    schema = StructType([*df.select(*carried).schema.fields, StructField("code_vec", vectors), StructField("query_vec", vectors)])
    return df.mapInPandas(kernel, schema)


def embed_lookup(df: DataFrame, ids_col: str, weights: DataFrame, tower: str = "shared",
                 id_col: str = "row_id") -> DataFrame:
    """E1 (oracle form): ``(row_id, pos, token_id, vec)`` by an equi-join on the id.

    The embedding table is bounded by the vocabulary; AQE broadcasts it when
    it measures small.
    """
    emb = weights.where(F.col("param") == f"{tower}/embed").select(
        F.col("row").alias("token_id"), F.col("values").alias("vec"))
    toks = df.select(id_col, F.posexplode(ids_col).alias("pos", "token_id"))
    return toks.join(emb, "token_id")


def encode_with(df: DataFrame, ids_col: str, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
                weights: DataFrame, tower: str = "shared", id_col: str = "row_id",
                out_col: str = "vec") -> DataFrame:
    """Any encoder ``(B, L) ids -> (B, L, D) states``, then mean-pool, linear, BN, tanh.

    ``make_encoder`` is called once per Python worker (weights are the
    caller's to supply); the head comes from the weight table.
    """
    ship_package(df.sparkSession)
    head = load_towers(weights)[tower]
    bc = df.sparkSession.sparkContext.broadcast(head)
    holder: dict = {}

    def kernel(batches):
        enc = holder.get("enc")
        if enc is None:
            enc = holder["enc"] = make_encoder()
        t = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            ids = _ids_matrix(pdf[ids_col])
            pooled = [np.asarray(enc(ids[rows]), dtype=np.float64).mean(axis=1) for rows in _row_slices(ids, t.fc_w.shape[1])]
            out = t.head(np.concatenate(pooled))
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(dtype=np.int64), out_col: list(out)})

    return df.select(id_col, ids_col).mapInPandas(kernel, f"{id_col} long, {out_col} array<double>")


def batchnorm_stats(df: DataFrame, vec_col: str) -> DataFrame:
    """Per-dimension mean and population variance of a vector column."""
    return (df.select(F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))
              .groupBy("dim")
              .agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.count(F.lit(1)).alias("n")))


def token_frequency(df: DataFrame, ids_col: str, batch_col: str = "batch_id") -> DataFrame:
    """How often each token id occurs in each mini-batch."""
    return (df.select(batch_col, F.explode(ids_col).alias("token_id"))
              .groupBy(batch_col, "token_id").agg(F.count(F.lit(1)).alias("freq")))

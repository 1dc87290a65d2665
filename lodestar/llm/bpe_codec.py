"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of byte symbols. The leaves of a segment tree hold
``rank << 32 | position`` of every adjacent pair, inner nodes the minimum of
their children, so the root names the leftmost pair of lowest rank. A merge
rewrites at most three leaves and their ancestors; the loop ends when no
mergeable pair is left. A piece of n symbols costs O(n log n) however long it is.

Spark partitions the rows and the kernel works on one Arrow batch at a time:
there is no shuffle, and a lost task is simply run again. The vocabulary file
(fixed size, a few MB) is read on the driver and broadcast.

Defined results: a null text is treated as empty and gives no ids; null ids
decode to the empty string; an id outside the vocabulary raises an error.
Extra columns pass through; an existing column named like the output is replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import small_batches

_NONE = 1 << 62
_POSITION = (1 << 32) - 1

# --- fixed values: the byte-level pre-tokenizer of the vocabulary files ------
_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+"
                 r"|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+")
# The same cuts in the standard library's faster syntax. It is exact for texts
# of the characters LATIN only, where \w, \d and \s agree with \p{L}, \p{N}, _SPACE.
LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_LATIN_PATTERN = r"[^\t-\r -~\u00a0-\u024f]|[\u00b2\u00b3\u00b9\u00bc-\u00be]"
# ---------------------------------------------------------------------------


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 bytes stand for themselves,
    the others take the code points from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def merge_symbols(symbols: list[int], ranks: dict[int, int], merged: list[int], base: int) -> list[int]:
    """Apply merges to one row of symbol ids, lowest rank first, leftmost on ties.

    ``ranks`` maps ``left * base + right`` to a rank, ``merged`` a rank to the new id.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(symbols[i] * base + symbols[i + 1])
        if r is not None:
            tree[size + i] = r << 32 | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == _NONE:
        return symbols
    out = list(symbols)
    after = list(range(1, n + 1))       # next live symbol, n at the end
    before = list(range(-1, n - 1))     # previous live symbol, -1 at the start

    def put(leaf: int, value: int) -> None:
        k = size + leaf
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (top := tree[1]) != _NONE:
        i = top & _POSITION
        gone = after[i]
        end = after[gone]
        out[i] = merged[top >> 32]
        out[gone] = -1
        after[i] = end
        if gone < n - 1:
            put(gone, _NONE)
        if end < n:
            before[end] = i
            r = get(out[i] * base + out[end])
            put(i, _NONE if r is None else r << 32 | i)
        else:
            put(i, _NONE)
        p = before[i]
        if p >= 0:
            r = get(out[p] * base + out[i])
            put(p, _NONE if r is None else r << 32 | p)
    return [s for s in out if s >= 0]


class PairTable:
    """Ranks of symbol pairs for numpy arrays: one binary search in the sorted pair keys."""

    def __init__(self, ranks: dict[int, int], merged: list[int], base: int):
        keys = np.fromiter(ranks.keys(), np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.fromiter(ranks.values(), np.int64, len(ranks))[order]
        self.merged = np.array(merged, np.int64)
        self.base = base

    def leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at] << 32 | position, _NONE)


def merge_rows(rows: list[bytes], byte_id: np.ndarray, pairs: PairTable, size: int) -> list[bytes]:
    """``merge_symbols`` for many short rows at once: one segment tree per row, as numpy rows.

    Every row has at most ``size`` symbols (a power of two). Each round merges
    the root's pair of every row that still has one and updates three leaves
    and their ancestors; rows that are done leave the working set. Gives the int32 ids of each row as bytes.
    """
    w, width, stop = len(rows), size + 1, pairs.base - 1      # stop: a symbol that no pair holds
    n = np.fromiter(map(len, rows), np.int64, w)
    sym = np.full((w, width), stop, np.int64)
    flat = np.frombuffer(b"".join(rows), np.uint8)
    row_of = np.repeat(np.arange(w), n)
    col_of = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    sym[row_of, col_of] = byte_id[flat]
    after = np.minimum(np.arange(1, width + 1), size)[None, :].repeat(w, 0)
    after[row_of, col_of] = col_of + 1
    before = np.arange(-1, width - 1)[None, :].repeat(w, 0)
    tree = np.full((w, 2 * size), _NONE, np.int64)
    spots = np.arange(size)
    tree[:, size:] = pairs.leaf(sym[:, :-1], sym[:, 1:], spots[None, :])
    for k in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    sym_f, after_f, before_f, tree_f = sym.ravel(), after.ravel(), before.ravel(), tree.ravel()
    live = np.flatnonzero(tree[:, 1] != _NONE)
    levels = size.bit_length() - 1
    while len(live):
        top = tree_f[live * (2 * size) + 1]
        o, to = live * width, live * (2 * size)
        i = top & _POSITION
        gone = after_f[o + i]
        end = after_f[o + gone]
        new = pairs.merged[top >> 32]
        sym_f[o + i] = new
        sym_f[o + gone] = -1
        after_f[o + i] = end
        before_f[o + end] = i
        p = before_f[o + i]
        here = pairs.leaf(new, sym_f[o + end], i)
        prior = np.where(p >= 0, pairs.leaf(sym_f[o + np.maximum(p, 0)], new, p), here)
        p = np.where(p >= 0, p, i)
        tree_f[to + size + gone] = _NONE
        tree_f[to + size + i] = here
        tree_f[to + size + p] = prior
        nodes = [gone + size, i + size, p + size]
        for _ in range(levels):
            for j, k in enumerate(nodes):
                k = nodes[j] = k >> 1
                tree_f[to + k] = np.minimum(tree_f[to + 2 * k], tree_f[to + 2 * k + 1])
        live = live[tree_f[to + 1] != _NONE]
    keep = sym >= 0
    keep &= np.arange(width)[None, :] < n[:, None]
    data = sym[keep].astype(np.int32).tobytes()
    ends = (np.cumsum(keep.sum(1)) * 4).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """One vocabulary: text -> ids and ids -> text. Knows nothing of Spark."""

    MEMO_ENTRIES = 800_000    # pieces remembered per worker; emptied when full
    MEMO_CHARS = 64           # longer ones are not kept
    ROW_BYTES = 64            # longer pieces get a tree of their own

    def __init__(self, spec: str):
        conf = json.loads(spec)
        vocab: dict[str, int] = conf["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.byte_id = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        last = max([*vocab.values(), *self.special.values()])
        self.base = last + 2
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(conf["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] * self.base + vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.pairs = PairTable(self.ranks, self.merged, self.base)
        self.bytes_of: list[bytes | None] = [None] * (last + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cut_special = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                          + ")") if self.special else None)
        self.find_any = regex.compile(PIECE_PATTERN).findall
        self.find_latin = re.compile(LATIN_PATTERN).findall
        self.not_latin = re.compile(NOT_LATIN_PATTERN).search
        self.memo: dict[str, bytes] = {}

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """int32 ids of each piece, as bytes."""
        found: dict[str, bytes] = {}
        names: dict[int, list[str]] = {}
        rows: dict[int, list[bytes]] = {}
        for p in pieces:
            b = p.encode()
            size = max(2, 1 << (len(b) - 1).bit_length())
            names.setdefault(size, []).append(p)
            rows.setdefault(size, []).append(b)
        for size, same in rows.items():
            if size > self.ROW_BYTES or len(same) < 32:
                ids = [np.array(merge_symbols(self.byte_id[list(b)].tolist(), self.ranks, self.merged, self.base),
                                np.int32).tobytes() for b in same]
            else:
                ids = merge_rows(same, self.byte_id, self.pairs, size)
            found.update(zip(names[size], ids))
        return found

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; special tokens stay whole."""
        if self.cut_special is not None and self.cut_special.search(text):
            return [p for part in self.cut_special.split(text) if part
                    for p in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return (self.find_any if self.not_latin(text) else self.find_latin)(text)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """int32 ids of each text; null and empty texts have none."""
        cut = [self.pieces(t) if t else [] for t in texts]
        fresh: set[str] = set()
        for pieces in cut:
            fresh.update(pieces)
        memo = self.memo
        if len(memo) > self.MEMO_ENTRIES:
            memo.clear()
        new = [p for p in fresh if p not in memo]
        known = self._encode_pieces([p for p in new if p not in self.special])
        known |= {p: np.int32(self.special[p]).tobytes() for p in new if p in self.special}
        memo.update(known)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, pieces)), np.int32) for pieces in cut]
        for p in known:
            if len(p) > self.MEMO_CHARS:
                del memo[p]
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> str:
        if ids is None:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_CODECS: dict[int, Codec] = {}     # one per worker and vocabulary


def _codec(key: int, shared) -> Codec:
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [values], names=[*names, name])


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _share(df: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as fh:
        spec = fh.read()
    return df.sparkSession.sparkContext.broadcast(spec)


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Add ``out_col``: the token ids of the whole text. ``vocabulary`` is a path on the driver."""
    small_batches(df.sparkSession)
    shared = _share(df, vocabulary)
    key = hash(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            ids = codec.encode_many(batch.column(text_col).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
            yield _with_column(batch, out_col, pa.ListArray.from_arrays(pa.array(ends), values))

    return df.mapInArrow(run, _schema_with(df, out_col, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the text of the ids, special tokens kept, invalid bytes replaced."""
    small_batches(df.sparkSession)
    shared = _share(df, vocabulary)
    key = hash(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for batch in batches:
            texts = [codec.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield _with_column(batch, out_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _schema_with(df, out_col, T.StringType()))


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """The digest columns of encoded and decoded rows."""
    ids = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return [F.size(ids_col).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
            F.sha2(F.col(decoded_col), 256).alias("decoded_sha256")]

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe_codec

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, texts):
    ours = [x.tolist() for x in codec.encode_many(texts)]
    theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert ours == theirs
    assert [codec.decode(x) for x in ours] == [library.decode(x, skip_special_tokens=False) for x in theirs]


def test_every_kind_of_character(codec, library):
    points = [c for c in [*range(0x3100), *range(0x3100, 0x110000, 211)] if not 0xD800 <= c < 0xE000]
    same(codec, library, [f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}x" for c in points])


def test_random_texts(codec, library):
    random.seed(3)
    parts = [*" \n\t.,'sadmtrevl1é\x85\x1c　²_", "<|endoftext|>", "<|end", "'ll", "   ", "the", " of", "日"]
    same(codec, library, ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(4000)])


def test_long_pieces(codec, library):
    same(codec, library, ["ab" * 20_000, "é" * 3000, " " * 5000 + "x", "=" * 999, "x" * 65, "y" * 64])


def test_tree_matches_plain_merging(codec):
    """The segment tree against scanning for the lowest rank, leftmost first."""
    random.seed(4)
    for _ in range(300):
        symbols = [int(codec.byte_id[b]) for b in random.choices(b"theandofing ", k=random.randint(1, 20))]
        plain = list(symbols)
        while True:
            ranked = [(codec.ranks[a * codec.base + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:]))
                      if a * codec.base + b in codec.ranks]
            if not ranked:
                break
            r, i = min(ranked)
            plain[i:i + 2] = [codec.merged[r]]
        assert bpe_codec.merge_symbols(symbols, codec.ranks, codec.merged, codec.base) == plain


def test_frames(spark, rows, clashing, empty, library):
    coded = bpe_codec.decode(bpe_codec.encode(clashing, PATH), PATH).select("doc_id", "text", "ids", "decoded", "kept").collect()
    assert len(coded) == rows.count()
    for r in coded:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.kept == "x"
    assert bpe_codec.decode(bpe_codec.encode(empty, PATH), PATH).count() == 0
    with pytest.raises(Exception):
        bpe_codec.Codec(open(PATH, encoding="utf-8").read()).decode([10 ** 6])


def test_memo_never_changes_results(codec, library):
    small = bpe_codec.Codec(open(PATH, encoding="utf-8").read())
    small.MEMO_ENTRIES = 3
    for t in ["some words here", "other words there", "some words here again"]:
        assert small.encode(t) == library.encode(t, add_special_tokens=False).ids

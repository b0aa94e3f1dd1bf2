import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from textprep_spark.llm import bpe, catalog

SMALL = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(FILE), public_tokenizers.PATTERN)


def test_random_texts(codec, reference):
    chance = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "1", "'s", "'ll", "!", "\x1c", "\xa0", "\x85", "\u2003", "😀", "the", "tion", "<|endoftext|>"]
    texts = ["".join(chance.choices(parts, k=chance.randint(0, 30))) for _ in range(5000)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["a", " ", "ab", "é", "thetion", "0", "!?"])
@pytest.mark.parametrize("n", [3, 40, 30_000])
def test_long_pieces(codec, reference, unit, n):
    assert codec.encode(unit * n) == reference.encode_ordinary(unit * n)


def test_one_tree_and_many_trees_agree(codec):
    chance = random.Random(8)
    for width in bpe.WIDTHS:
        pieces = [bytes(chance.choices(b"etaoin \xc3\xa9", k=chance.randint(2, width))) for _ in range(300)]
        packed = bpe.merge_pieces(pieces, width, codec.of_byte, codec.pairs)
        for piece, ids in zip(pieces, packed):
            if piece not in codec.ranks:
                assert ids == bpe._packed(bpe.merge_piece(piece, codec.ranks))


def test_full_caches_change_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHED", 5)
    small = bpe.Codec(bpe.read_ranks(FILE), public_tokenizers.PATTERN)
    for text in ["one two three four five six seven", "one eight nine ten", "x" * 200 + " one", "one x"] * 3:
        assert small.encode(text) == reference.encode_ordinary(text)


def test_columns(spark, reference):
    own = bpe.byte_bpe(spark, FILE, public_tokenizers.PATTERN)
    texts = [None, "", "a b", "a b", " é\n", "w " * 100_000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, ids int")
    rows = df.select("text", own.encode("text").alias("x"), own.round_trip("text").alias("r")).select("*", own.decode("x").alias("d")).collect()
    for r in rows:
        ids = reference.encode_ordinary(r.text or "")
        assert r.x == r.r.ids == ids and r.d == r.r.decoded == (r.text or "").encode()
    assert df.limit(0).select(own.encode("text")).collect() == []


def test_whole_table(spark, reference):
    rows = {r.doc_id: r for r in catalog.CATALOG["op7_byte_bpe"].run(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids, r = reference.encode_ordinary(d.text or ""), rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()

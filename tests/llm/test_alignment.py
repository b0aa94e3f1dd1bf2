"""Token alignment against whole texts read by both libraries, and decoded byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from textprep_spark.llm import alignment, catalog

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b ", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "ñandú", "日本", "😀", "👩‍👧", "the", "tion", "'s", "12", "1", ".", ",", "!", "\x00",
         "\x1c", "\x85", "\xa0", " ", "▁", "<s>", "<0x41>", "<|endoftext|>", " ⁇ ", "ﬁ", "é", "﻿", "𐍈", "​"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


@pytest.fixture(scope="module")
def units():
    with open(A_FILE, encoding="utf-8") as a, open(B_FILE, "rb") as b:
        return alignment.Units(alignment.Tokenizers(a.read(), b.read()))


_alphabet = alignment.byte_alphabet()


def plain_groups(tools, text):
    """The groups of a text as lists of ids, token by token; None without tokens."""
    if not text:
        return None
    a, b = tools
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(_alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b, bytes_b = b.encode(text), []
    for i in ids_b:
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in parts]) for parts in (bytes_a, bytes_b))
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups, i, j = [], 0, 0
    for cut in cuts:
        x, y = i, j
        while i < len(ids_a) and ends_a[i] <= cut:
            i += 1
        while j < len(ids_b) and ends_b[j] <= cut:
            j += 1
        groups.append((ids_a[x:i], ids_b[y:j]))
    return groups


def plain(tools, rows):
    found = [(doc_id, plain_groups(tools, text)) for doc_id, text in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, groups in found for g in groups or ())
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for doc_id, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups or ()]
        told = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups or ())
        out.append(
            (doc_id, sum(len(g[0]) for g in groups or ()), sum(len(g[1]) for g in groups or ()), len(links), len(links),
             sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(told.encode()).hexdigest() if groups else "")
        )
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def random_texts(n, longest):
    chance = random.Random(n)
    return ["".join(chance.choices(PARTS, k=chance.randint(0, longest))) for _ in range(n)]


def test_coarse_cuts_are_refined_by_bytes(tools, units):
    for text in random_texts(2000, 12):
        if not text or "▁" in text:
            continue
        found = units.tokenizers.align(" " + text)
        groups = plain_groups(tools, text)
        assert (found is None) == (groups is None), text
        if groups:
            a = np.split(found.a, found.a_ends)[:-1]
            b = np.split(found.b, found.b_ends)[:-1]
            assert [(x.tolist(), y.tolist()) for x, y in zip(a, b)] == groups, text


def test_spans_alone_place_ordinary_tokens():
    # é and 😀 in two and four tokens: the first ones report the whole character
    starts, ends = np.array([0, 2, 2, 4, 5, 5, 5, 5]), np.array([2, 4, 4, 5, 9, 9, 9, 9])
    assert alignment.refined(starts, ends, np.array([2, 1, 1, 1, 1, 1, 1, 1])).tolist() == [2, 3, 4, 5, 6, 7, 8, 9]
    # byte fallback: the last one reports all
    starts, ends = np.array([0, 1, 1, 1, 1]), np.array([1, 1, 1, 1, 5])
    assert alignment.refined(starts, ends, np.array([1, 1, 1, 1, 1])).tolist() == [1, 2, 3, 4, 5]
    assert alignment.refined(starts, ends, np.array([1, 1, 1, 1, 2])) is None


def test_units_make_up_the_text_and_align_alike(tools, units):
    assert units.tokenizers.local
    texts = random_texts(1500, 25)
    cut = [units.tokenizers.units(t) for t in texts if t]
    assert ["".join(u) for u in cut] == [" " + t for t in texts if t]
    units.learn(set().union(*cut))
    for text, own in zip((t for t in texts if t), cut):
        at = [units.known[u] for u in own]
        groups = plain_groups(tools, text)
        if groups is None:
            assert any(units.a[i] < 0 for i in at), text
        else:
            told = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
            assert b";".join(units.groups[i] for i in at).decode() == told, text


def test_packed_numbers():
    for numbers in ([], [0], [5, 5, 1, 70_000, 3, 2**31]):
        assert alignment.unpacked(alignment.packed(np.array(numbers, dtype=np.int64))).tolist() == sorted(numbers)


def test_texts_that_cannot_be_cut(tools, units):
    whole = alignment.Units(units.tokenizers)
    whole.tokenizers = type("Whole", (), {"local": False, "align": units.tokenizers.align, "units": lambda self, t: [" " + t]})()
    texts = random_texts(300, 20)
    rows = alignment._aligned(whole, 1, list(range(300)), texts).to_pylist()[:-1]
    expected = plain(tools, list(enumerate(texts)))
    assert {(r["doc_id"], r["n_a"], r["n_b"], r["n_links"], r["groups_sha256"]) for r in rows} == {(*e[:3], e[4], e[7]) for e in expected}


def test_against_whole_texts(spark, tools):
    rows = list(enumerate(random_texts(400, 30)))
    rows += [(7, None), (None, "a null id"), (None, None), (900, "twice"), (900, "twice"), (901, "x" * 50_000), (902, " "), (903, "\n"), (904, "ab " * 3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, units string, batch long").repartition(3)
        assert aligned(alignment.align(df, A_FILE, B_FILE)) == plain(tools, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert aligned(alignment.align(df, A_FILE, B_FILE)) == []


def test_query_on_a_whole_table(spark, tools):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = aligned(catalog.CATALOG["op12_token_alignment"].run(spark, folder))
    assert got == plain(tools, rows) and sum(r[4] for r in got) > 10_000


def test_marks_behind_known_words_are_not_tokenized_again(tools):
    """A word's full stop or comma: the groups of whole texts, without another pass over the word."""
    own = alignment.Units(alignment.Tokenizers(*units_files()))
    words = ["wertolun", "éàñör", "x", "a.b", "1a", "co-op", "naïve"]
    texts = [" " + " ".join([*words, "".join(m)]) for m in (["end"], ["3.,"], ["²."], ["a..,"], ["中,"], ["(a).,"])]
    own.learn(set().union(*map(own.tokenizers.units, texts)))
    passes, align = [], own.tokenizers.align
    own.tokenizers.align = lambda text: passes.append(text) or align(text)
    marked = [" " + " ".join(w + m for w in words) for m in ".,"]
    own.learn(set().union(*map(own.tokenizers.units, marked)))
    assert passes == []
    for text in texts + marked:
        cut = own.tokenizers.units(text[1:])
        own.learn(set(cut))
        at = [own.known[u] for u in cut]
        groups = plain_groups(tools, text[1:])
        told = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        assert b";".join(own.groups[i] for i in at).decode() == told, text
        assert sum(own.a[i] for i in at) == sum(len(a) for a, _ in groups)
        assert sum(own.b[i] for i in at) == sum(len(b) for _, b in groups)
        links = np.frombuffer(b"".join(own.links[i] for i in at), dtype=own.code)
        half = 4 * own.code.itemsize
        assert [(int(x) >> half, int(x) & (1 << half) - 1) for x in links] == [(a[-1], b[-1]) for a, b in groups]


def units_files():
    with open(A_FILE, encoding="utf-8") as a, open(B_FILE, "rb") as b:
        return a.read(), b.read()

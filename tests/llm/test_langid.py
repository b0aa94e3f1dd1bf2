"""Language identification against sums over every cut, and on documents that it has not seen."""

import itertools
import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from textprep_spark.llm import catalog, langid

FILE = public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "é"]


def cuts(word, pieces):
    """Every way of cutting a word into pieces; a letter that is no piece is unknown."""
    for marks in itertools.product((False, True), repeat=len(word) - 1):
        ends = [i + 1 for i, m in enumerate(marks) if m] + [len(word)]
        parts = [word[i:j] for i, j in zip([0, *ends], ends)]
        if all(p in pieces or len(p) == 1 for p in parts):
            yield [pieces.index(p) if p in pieces else len(pieces) for p in parts]


@pytest.fixture(scope="module")
def lattices():
    chances = np.random.default_rng(1).dirichlet(np.ones(len(PIECES) + 1), size=3)
    return langid.Lattices(PIECES, chances), chances


@pytest.mark.parametrize("word", ["▁", "▁a", "▁abab", "▁babba", "▁xaéb", "▁日ab"])
def test_sums_over_all_cuts(lattices, word):
    sums, chances = lattices
    every = [c for c in cuts(word, PIECES)]
    for language in range(3):
        own = chances[language].copy()
        own[-1] /= langid.LETTERS
        weights = [math.prod(own[c]) for c in every]
        assert sums.log_sums([word])[0, language] == pytest.approx(math.log(sum(weights)))
        expected = np.zeros(len(PIECES) + 1)
        for cut, weight in zip(every, weights):
            np.add.at(expected, cut, 7 * weight / sum(weights))
        got = sums.expected([word], np.array([language]), np.array([7]))
        assert got[language] == pytest.approx(expected) and got.sum() == pytest.approx(expected.sum())


@pytest.mark.parametrize("n", [31, 32, 33, 200])
def test_long_words_by_logarithms(lattices, n):
    sums, _ = lattices
    word = "▁" + ("abbaé" * n)[: n - 1]
    long = sums._long_forward(word)[-1]
    assert np.isfinite(long).all() and sums.log_sums([word])[0] == pytest.approx(long)
    by_log = np.zeros(len(PIECES) + 2)
    sums._add_long(by_log, word, 1, 2)
    assert sums.expected([word], np.array([1]), np.array([2]))[1] == pytest.approx(by_log[:-1])


def test_vocabulary_is_found_again():
    pieces = langid.usable_pieces(langid.read_pieces(FILE))
    table = langid.PieceTable(pieces)
    for length in set(map(len, pieces)):
        same = [p for p in pieces if len(p) == length]
        hashes = np.zeros(len(same), dtype=np.uint64)
        for row in langid.characters(same):
            hashes = table.longer(hashes, row)
        assert [pieces[i] for i in table.find(hashes)] == same
    assert "▁the" in pieces and not any(c.isdigit() or c == "\n" for p in pieces for c in p)


def test_words():
    assert langid.words_of("Él, l'eau 3x²y\t_Ⅳa") == ["él", "l", "eau", "x", "y", "a"]
    assert langid.words_of(None) == langid.words_of("12 !\n²") == []


def test_edge_cases(spark):
    rows = [
        (1, "the cat and the dog", "en", "x"),
        (2, "der Hund und die Katze", "de", "x"),
        (3, None, "en", "x"),
        (4, "the house", None, "x"),
        (5, "", "de", "x"),
        (6, "123 ...", "de", "x"),
        (6, "123 ...", "de", "x"),
        (None, "und die", None, "x"),
        (8, "the" * 100_000, None, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string")
    model = langid.fit(df, FILE)
    told = df.select("*", model.predict(F.col("text")).alias("told")).collect()
    of = {(r.doc_id, r.text and r.text[:9]): (r.told.lang, r.told.score) for r in told}
    assert len(told) == len(rows)
    assert of[1, "the cat a"][0] == of[4, "the house"][0] == of[8, "thethethe"][0] == "en"
    assert of[2, "der Hund "][0] == of[None, "und die"][0] == "de"
    assert of[3, None] == of[5, ""] == of[6, "123 ..."] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in of.values())
    for empty in (df.limit(0), df.where("lang is null")):
        none = langid.fit(empty, FILE)
        assert {tuple(r.told) for r in df.select(none.predict(F.col("text")).alias("told")).collect()} == {("und", 0.0)}
    assert df.limit(0).select(model.predict(F.col("text"))).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([("a", x) for x in "abc"], "text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(df, FILE)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    told = catalog.CATALOG["op11_language_id"].run(spark, folder)
    assert told.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = told.join(truth, "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang_pred == r.lang for r in rows) / len(rows)
    assert told.count() == truth.count() and len(rows) > 150 and right >= 0.98, right

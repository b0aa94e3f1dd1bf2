"""Learned sentence boundaries against plain counting and cutting."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textprep_spark.operators import boundaries as B
from textprep_spark.operators.pairs import adjacent_pairs


def core(token):
    return re.sub(r"[^a-zA-Z0-9.]+$", "", re.sub(r"^[^a-zA-Z0-9]+", "", token))


def kind(word):
    return re.sub(r"\.$", "", word).lower()


def plain_counts(texts):
    dotted, plain = Counter(), Counter()
    for text in texts:
        for token in (text or "").split():
            c = core(token)
            if re.search("[a-zA-Z]", kind(c)):
                (dotted if c.endswith(".") else plain)[kind(c)] += 1
    return dotted, plain


def plain_scores(texts):
    dotted, plain = plain_counts(texts)
    p = sum(dotted.values()) / (sum(dotted.values()) + sum(plain.values()))
    out = {}
    for w, d in dotted.items():
        n, inner = plain[w], w.count(".")
        size = len(w) - inner
        ratio = d * math.log(0.99) + n * math.log(0.01) - d * math.log(p) - n * math.log(1 - p)
        out[w] = 2 * ratio * math.exp(-size) * (inner + 1) * float(size) ** -n
    return out


def plain_starters(texts, abbreviations):
    dotted, plain = plain_counts(texts)
    times, total = dotted + plain, sum(dotted.values()) + sum(plain.values())
    breaks, starts = 0, Counter()
    for text in texts:
        words = (text or "").split()
        for a, b in zip(words, words[1:]):
            c = core(a)
            abbreviated = kind(c) in abbreviations or re.fullmatch("[a-z]", kind(c))
            if (c.endswith(".") and not abbreviated) or re.search(r"[!?][^a-zA-Z0-9]*$", a):
                breaks += 1
                starts[kind(core(b))] += core(b)[:1].isupper()
    out = {}
    for w, ab in starts.items():
        if not ab or w not in times:
            continue
        b = times[w]

        def ll(k, n, p):
            p = min(max(p, 1e-12), 1 - 1e-12)
            return k * math.log(p) + (n - k) * math.log(1 - p)

        rest, others = total - breaks, max(b - ab, 0)
        score = 2 * (ll(ab, breaks, ab / breaks) + ll(others, rest, others / rest) - ll(ab, breaks, b / total) - ll(others, rest, b / total))
        out[w] = score if ab / breaks > b / total else 0.0
    return out


def plain_split(text, splitter):
    """Sentences, word by word."""
    if text is None:
        return None
    pieces, sentences = re.split(r"(?<=[.!?])(?=\s)", text), []
    for i, piece in enumerate(pieces):
        if i:
            last, first = re.search(r"(\S*)$", pieces[i - 1])[0], core((piece.split() or [""])[0])
            c = core(last)
            bound = last.endswith(".") and (kind(c) in splitter.abbreviations or re.fullmatch("[a-z]", kind(c)))
            if not bound or (kind(first) in splitter.starters and first[:1].isupper()):
                sentences.append(piece.lstrip(" \t\n\x0b\f\r"))
                continue
        if i:
            sentences[-1] += piece
        else:
            sentences.append(piece)
    return [s for s in sentences if s]


@pytest.fixture(scope="module")
def texts():
    chance, out = random.Random(3), []
    nouns = [f"{a}{b}" for a in ("ri", "la", "mo", "te", "su") for b in ("ver", "ke", "untain", "mple", "rface")]
    for _ in range(400):
        sentences = []
        for _ in range(chance.randint(1, 6)):
            words = [chance.choice(["The", "The", "It", "However"])] + chance.choices(nouns + ["the", "it"], k=chance.randint(3, 9))
            at = chance.randrange(1, len(words))
            words.insert(at, chance.choice(["Dr. " + chance.choice(["Kole", "Maru"]), "e.g.", "approx. " + chance.choice(nouns), "the", "J. Kole"]))
            sentences.append(" ".join(words) + chance.choice([".", ".", ".", "!", "?", ".)"]))
        out.append(chance.choice([" ", "  ", "\n"]).join(sentences))
    return out + [None, "", " ", "..."]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)


def test_counts_and_scores(spark, texts):
    df = frame(spark, texts)
    counts = B.type_counts(df, "text")
    dotted, plain = plain_counts(texts)
    assert {r.word: (r.dotted, r.plain) for r in counts.collect()} == {w: (dotted[w], plain[w]) for w in {*dotted, *plain}}
    got = {r.word: r.score for r in B.abbreviation_scores(counts).collect()}
    assert got == pytest.approx(plain_scores(texts))
    got = {r.word: r.score for r in B.starter_scores(df, "text", counts, ["dr", "e.g", "approx"]).collect()}
    assert got == pytest.approx(plain_starters(texts, {"dr", "e.g", "approx"}))


def test_abbreviations_are_learned_and_not_cut(spark, texts):
    splitter = B.learn_splitter(frame(spark, texts), "text")
    assert {"dr", "e.g"} <= set(splitter.abbreviations) and "river" not in splitter.abbreviations
    assert {"the", "however"} <= set(splitter.starters)
    cases = [
        ("We met Dr. Kole. It was late.", ["We met Dr. Kole.", "It was late."]),
        ("Rivers, e.g. the Mara, rise.  They fall!", ["Rivers, e.g. the Mara, rise.", "They fall!"]),
        ("Ask J. Kole about it.\nHe knows.", ["Ask J. Kole about it.", "He knows."]),
        ("See the list, e.g. The river is low.", ["See the list, e.g.", "The river is low."]),
        ("A￿ bee. ￾ C￾f. D", ["A￿ bee.", "￾ C￾f.", "D"]),
        (" Lead. Trail. ", [" Lead.", "Trail."]),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "text string")
    got = {r[0]: r[1] for r in df.select("text", splitter(F.col("text"))).collect()}
    assert got == dict(cases)


def test_splitting_as_a_plain_version(spark, texts):
    splitter = B.learn_splitter(frame(spark, texts), "text")
    df = frame(spark, texts)
    out = df.select("i", splitter(F.col("text")).alias("s"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.s for r in out.collect()} == {i: plain_split(t, splitter) for i, t in enumerate(texts)}
    pairs = adjacent_pairs(df, "i", "text", splitter).collect()
    want = [(i, k, a, b) for i, t in enumerate(texts) for s in [plain_split(t, splitter) or []] for k, (a, b) in enumerate(zip(s, s[1:]))]
    assert sorted(map(tuple, pairs)) == want


def test_long_and_empty(spark):
    none = B.learn_splitter(frame(spark, []), "text")
    assert none == B.SentenceSplitter([], [])
    long = "Word e.g. word. " * 100_000
    got = spark.createDataFrame([(long,), (None,)], "t string").select(none(F.col("t")).alias("s")).collect()
    assert sorted(len(r.s or ()) for r in got) == [0, 200_000]
    assert len(B.learn_splitter(frame(spark, ["a b. c d. e f."] * 50), "text", most=1).abbreviations) <= 1

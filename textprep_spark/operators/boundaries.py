"""Sentence boundaries learned from the texts themselves.

A full stop ends a sentence unless it belongs to an abbreviation, and abbreviations give themselves away:
a short word that hardly ever stands without its full stop is bound to it. For every word type, the
number of times it stands with and without one is compared by a likelihood ratio with what chance would
give; length, inner full stops and occurrences without one weigh in (Kiss and Strunk, "Unsupervised
multilingual sentence boundary detection", 2006). An abbreviation's full stop may still end a sentence:
it does if the next word is one that texts begin sentences with far more often than chance would have
it, by Dunning's likelihood ratio, and has a capital letter here.

Both lists come from counts over all texts, made by two aggregations of word types; texts stay where they
are. The splitter is a column expression of built-in functions that holds the two lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABBREVIATION = 0.3  # score of an abbreviation, at least
STARTER = 30.0  # log-likelihood of a frequent sentence starter, more than
MOST = 5_000  # abbreviations and starters kept, the highest scores first

_GAP = "￿"  # in front of a sentence; no character, and escaped where a text holds one
_ESCAPE = "￾"


def _escaped(text: Column) -> Column:
    once = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e"))
    return F.replace(once, F.lit(_GAP), F.lit(_ESCAPE + "f"))


def _plain(text: Column) -> Column:
    once = F.replace(text, F.lit(_ESCAPE + "f"), F.lit(_GAP))
    return F.replace(once, F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _core(token: Column) -> Column:
    """A token without the quotes, brackets and commas around it; full stops stay."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}.]+$", "")


def _type(core: Column) -> Column:
    return F.lower(F.regexp_replace(core, r"\.$", ""))


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def type_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, dotted, plain): how often each word type with a letter stands with and without a full
    stop, over all texts."""
    core = texts.select(F.explode(_tokens(F.col(text))).alias("token")).select(_core(F.col("token")).alias("core"))
    words = core.select(_type(F.col("core")).alias("word"), F.endswith("core", F.lit(".")).alias("dot"))
    words = words.where(F.col("word").rlike(r"\p{L}"))
    return words.groupBy("word").agg(F.count_if("dot").alias("dotted"), F.count_if(~F.col("dot")).alias("plain"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """Adds ``score`` to ``counts`` (word, dotted, plain) of words that stand with a full stop."""
    totals = counts.agg(F.sum("dotted").alias("dots"), F.sum(F.col("dotted") + F.col("plain")).alias("all"))
    scored = counts.where("dotted > 0").join(F.broadcast(totals))  # one row
    chance = F.least(F.col("dots") / F.col("all"), F.lit(1 - 1e-12))
    null = F.col("dotted") * F.log(chance) + F.col("plain") * F.log(1 - chance)
    bound = F.col("dotted") * F.log(F.lit(0.99)) + F.col("plain") * F.log(F.lit(0.01))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    size = F.length("word") - inner
    score = 2 * (bound - null) * F.exp(-size) * (inner + 1) / F.pow(size, F.col("plain"))
    return scored.select("word", "dotted", "plain", score.alias("score"))


def _ends(core: Column, token: Column, abbreviations: list[str]) -> Column:
    """Whether a token ends a sentence as far as abbreviations tell."""
    stop = F.endswith(core, F.lit(".")) & ~_abbreviated(core, abbreviations)
    return stop | token.rlike(r"[!?][^\p{L}\p{N}]*$")


def _abbreviated(core: Column, abbreviations: list[str]) -> Column:
    kind = _type(core)
    initial = kind.rlike(r"^\p{L}$")
    return initial | (kind.isin(abbreviations) if abbreviations else F.lit(False))


def starter_scores(texts: DataFrame, text: str, counts: DataFrame, abbreviations: list[str]) -> DataFrame:
    """(word, starts, times, score): how strongly words with a capital letter are bound to the
    beginning of a sentence. ``counts`` are those of ``type_counts``."""
    tokens = _tokens(F.col(text))
    rows = texts.select(tokens.alias("t")).where("size(t) > 1")
    n = F.size("t") - 1
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n).alias("a"), F.slice("t", F.lit(2), n).alias("b"))
    pairs = rows.select(F.inline(pairs)).select("a", _core(F.col("a")).alias("core"), _core(F.col("b")).alias("next"))
    begun = pairs.where(_ends(F.col("core"), F.col("a"), abbreviations))
    starts = begun.where(F.col("next").rlike(r"^\p{Lu}")).groupBy(_type(F.col("next")).alias("word"))
    starts = starts.agg(F.count("*").alias("starts"))
    breaks = begun.agg(F.count("*").alias("breaks"))
    everything = counts.agg(F.sum(F.col("dotted") + F.col("plain")).alias("all"))
    rows = starts.join(counts.select("word", (F.col("dotted") + F.col("plain")).alias("times")), "word")
    rows = rows.join(F.broadcast(breaks)).join(F.broadcast(everything))  # one row each
    a, b, ab, total = (F.col(c).cast("double") for c in ("breaks", "times", "starts", "all"))

    def likelihood(hits: Column, tries: Column, p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
        return hits * F.log(p) + (tries - hits) * F.log(1 - p)

    rest, others = F.greatest(total - a, F.lit(1.0)), F.greatest(b - ab, F.lit(0.0))
    score = 2 * (
        likelihood(ab, a, ab / a)
        + likelihood(others, rest, others / rest)
        - likelihood(ab, a, b / total)
        - likelihood(others, rest, b / total)
    )
    over = ab / a > b / total
    return rows.select("word", "starts", "times", F.when(over, score).otherwise(0.0).alias("score"))


@dataclass(frozen=True)
class SentenceSplitter:
    """``splitter(text)`` maps a text column to an array of sentences."""

    abbreviations: list[str]
    starters: list[str]

    def __call__(self, text: Column) -> Column:
        """Sentences, the white space between them left out; empty ones are dropped. Null: null.

        Cutting takes time linear in the text: candidates are cut apart, a mark is put in front of
        those that begin a sentence, and all are joined and cut at the marks.
        """

        def begins(before: Column, piece: Column) -> Column:
            last = F.regexp_extract(before, r"(\S+)$", 1)
            first = _core(F.regexp_extract(piece, r"^\s+(\S+)", 1))
            known = _type(first).isin(self.starters) if self.starters else F.lit(False)
            bound = F.endswith(last, F.lit(".")) & _abbreviated(_core(last), self.abbreviations)
            return ~bound | (known & first.rlike(r"^\p{Lu}"))

        def marked(pieces: Column) -> Column:
            def mark(piece: Column, i: Column) -> Column:
                new = (i > 0) & begins(F.get(pieces, F.greatest(i - 1, F.lit(0))), piece)
                return F.when(new, F.concat(F.lit(_GAP), F.ltrim(piece, F.lit(" \t\n\x0b\f\r")))).otherwise(piece)

            return F.array_join(F.transform(pieces, mark), "")

        pieces = F.split(_escaped(text), r"(?<=[.!?])(?=\s)")
        # bound to a variable, so that the text is cut apart once
        whole = F.get(F.transform(F.array(pieces), marked), F.lit(0))
        sentences = F.transform(F.split(whole, _GAP), _plain)
        return F.when(text.isNotNull(), F.array_remove(sentences, F.lit("")))


def learn_splitter(texts: DataFrame, text: str, most: int = MOST) -> SentenceSplitter:
    """Learn abbreviations and sentence starters from a text column; at most ``most`` of each, which
    bounds what reaches the driver and every task. Null texts teach nothing; ties go by code point."""
    counts = type_counts(texts, text)
    scored = abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION)
    found = scored.orderBy(F.desc("score"), "word").limit(most).collect()
    abbreviations = sorted(r["word"] for r in found)
    scored = starter_scores(texts, text, counts, abbreviations).where(F.col("score") > STARTER)
    starters = sorted(r["word"] for r in scored.orderBy(F.desc("score"), "word").limit(most).collect())
    return SentenceSplitter(abbreviations, starters)

"""Learned decision lists over text statistics.

``text_stats`` counts per text what the rules look at. ``learn_rules`` learns, from labelled
statistics, an ordered list of conjunctions of thresholds by sequential covering: a rule is grown
condition by condition by information gain on two thirds of the rows, pruned from its end on the
other third, kept if it is precise there, and what it covers leaves the rows of the next rule. The
list becomes one ordered ``CASE WHEN`` expression: interpretable, and evaluated in the JVM.

Fitting uses a bounded sample of the labelled rows, at most ``SAMPLE_ROWS`` of them (those whose id
has the least hash, so reruns agree); only their statistics reach the driver. Everything else covers
every row and whole texts.

Null and empty texts have zero for every count. Statistics that are null, as in rows of an outer
join, satisfy no condition. Without labelled rows, or with one class only, no rule is learned and
none rejects. Repeated labels of one document count as often as they stand there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import bound_batches
from textprep_spark.shipping import ship

SAMPLE_ROWS = 20_000  # labelled rows that the rules are fitted on, at most
THRESHOLDS = 64  # per statistic
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_digits",
    "n_marks",
)
_SPACE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes of a character other than its first
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:"


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, inside = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            inside[i] = inside[i + 1] = inside[i + 2] = 1
    return sum(inside)


def count_text(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()  # bytes split at ASCII white space only
    lines = [line for line in text.split(b"\n") if line.strip()]
    size = len(text)

    def number_of(some: bytes) -> int:
        return size - len(text.translate(None, some))

    return (
        len(words),
        size - number_of(_SPACE + _INNER),
        number_of(_SYMBOLS),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        len(set(words)),
        number_of(_UPPER),
        number_of(_DIGITS),
        number_of(_MARKS),
    )


def _stats(texts: pa.Array) -> pa.Array:
    rows = [count_text(t) for t in texts.to_pylist()]
    columns = list(zip(*rows)) if rows else [()] * len(COUNTS)
    return pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], names=list(COUNTS)
    )


def text_stats(df: DataFrame, text: str = "text") -> Column:
    """The counts of a text column, as a struct."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    schema = ",".join(f"{c}:bigint" for c in COUNTS)
    return F.arrow_udf(_stats, f"struct<{schema}>")(df[text].cast("binary"))


def base_failed(stats: Column) -> Column:
    """Too short, or mostly repetition."""
    n, repeated = stats["n_words"], stats["n_repeat_words"]
    return F.coalesce((n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n), F.lit(True))


def features(stats: Column) -> dict[str, Column]:
    """What the rules may put thresholds on: sizes and rates, never null for counted texts."""

    def rate(part: str, whole: str) -> Column:
        return stats[part] / F.greatest(stats[whole], F.lit(1))

    return {
        "words": stats["n_words"].cast("double"),
        "chars_per_word": rate("word_chars", "n_words"),
        "symbols_per_word": rate("n_symbols", "n_words"),
        "marks_per_word": rate("n_marks", "n_words"),
        "upper_share": rate("n_upper", "word_chars"),
        "digit_share": rate("n_digits", "word_chars"),
        "repeated_share": rate("n_repeat_words", "n_words"),
        "distinct_share": rate("n_distinct_words", "n_words"),
        "repeated_lines": rate("n_dup_lines", "n_lines"),
        "words_per_line": rate("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool  # else at most
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.at_least else values <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        value = of[self.feature]
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each rejects what satisfies all its conditions."""

    rules: tuple[tuple[Condition, ...], ...]

    def first_match(self, of: dict[str, Column]) -> Column:
        """The number of the first rule that holds, from 1; null if none does."""
        chosen = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            every = F.lit(True)
            for condition in self.rules[i - 1]:
                every = every & condition.column(of)
            chosen = F.when(every, i).otherwise(chosen)
        return chosen

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules) or "no rule"


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], longest: int) -> list[Condition]:
    """Conditions, each the one of most information gain given those before it."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < longest and (p0 := int(bad[inside].sum())) < int(inside.sum()):
        before = math.log2(p0 / inside.sum()) if p0 else 0.0
        best, chosen = 0.0, None
        for f, name in enumerate(names):
            values = x[inside, f]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, THRESHOLDS), method="nearest"))
            order = np.sort(values)
            hits = np.sort(values[bad[inside]])
            for at_least in (True, False):
                side = "left" if at_least else "right"
                all_, p = np.searchsorted(order, cuts, side), np.searchsorted(hits, cuts, side)
                if at_least:
                    all_, p = len(order) - all_, len(hits) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(all_, 1)) - before), 0.0)
                i = int(np.argmax(gain))
                if gain[i] > best + 1e-9:
                    best, chosen = float(gain[i]), (f, Condition(name, at_least, float(cuts[i])))
        if chosen is None:
            break
        rule.append(chosen[1])
        inside &= chosen[1].holds(x[:, chosen[0]])
    return rule


def learn_rules(
    x: np.ndarray,
    bad: np.ndarray,
    pruning: np.ndarray,
    names: Sequence[str],
    min_precision: float = 0.97,
    min_covered: int = 5,
    longest: int = 4,
    most: int = 16,
) -> DecisionList:
    """A decision list for the rows where ``bad``; ``pruning`` marks the rows kept for pruning.

    ``min_precision`` is asked of a rule on the pruning rows that it covers, at least
    ``min_covered`` of them, so rules that reject good documents are not learned.
    """
    column = {name: i for i, name in enumerate(names)}
    rules, left = [], np.ones(len(bad), dtype=bool)

    def covered(rule: Sequence[Condition], rows: np.ndarray) -> np.ndarray:
        found = rows.copy()
        for c in rule:
            found &= c.holds(x[:, column[c.feature]])
        return found

    while len(rules) < most:
        growing = left & ~pruning
        if not bad[growing].any():
            break
        rule = _grow(x[growing], bad[growing], names, longest)
        if not rule:
            break

        def worth(part: list[Condition]) -> float:
            held = covered(part, left & pruning)
            p, n = int(bad[held].sum()), int((~bad[held]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        held = covered(rule, left & pruning)
        if held.sum() < min_covered or bad[held].mean() < min_precision:
            break
        rules.append(tuple(rule))
        left &= ~covered(rule, left)
    return DecisionList(tuple(rules))


def fit(
    documents: DataFrame, labels: DataFrame, bad_label: int = 0, sample_rows: int = SAMPLE_ROWS
) -> DecisionList:
    """A decision list for the labelled documents that pass the base rules.

    ``documents`` (doc_id, text), ``labels`` (doc_id, quality). The sample of the labels is bounded
    by ``sample_rows``, so it is broadcast; the statistics of its documents are collected.
    """
    sample = (
        labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label"))
        .where("labelled_id is not null and label is not null")
        .withColumn("order", F.xxhash64("labelled_id"))
        .orderBy("order", "labelled_id", "label")
        .limit(sample_rows)
    )
    texts = documents.select("doc_id", "text")
    found = texts.join(F.broadcast(sample), texts.doc_id == sample.labelled_id)
    counted = found.select("order", "label", text_stats(found).alias("stats"))
    of = features(F.col("stats"))
    failed = base_failed(F.col("stats")).alias("failed")
    rows = counted.select("order", "label", failed, *[c.alias(n) for n, c in of.items()]).toPandas()
    names = list(of)
    rows = rows[~rows["failed"]]  # here, as a filter would be pushed below the join with its counts
    rows = rows.sort_values(["order", "label", *names], kind="stable")
    bad = (rows["label"] == bad_label).to_numpy(dtype=bool)
    x = rows[names].to_numpy(dtype=float)
    pruning = (rows["order"].to_numpy(dtype=np.int64) % 3) == 0
    return learn_rules(x, bad, pruning, names)


def apply_rules(documents: DataFrame, rules: DecisionList) -> DataFrame:
    """(doc_id, stats, base_failed, rule, kept) of every document."""
    stats = documents.select("doc_id", text_stats(documents).alias("stats"))
    judged = stats.withColumn("base_failed", base_failed(F.col("stats"))).withColumn(
        "rule", rules.first_match(features(F.col("stats")))
    )
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())

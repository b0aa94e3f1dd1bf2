"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade <= k) = sigmoid(threshold_k - score)``: all grades share the weights of one score, the
thresholds between them are ordered. The score of a text sums the weights of its distinct words and
word beginnings, by hash, and of some rates of its writing. Beginnings carry what is known over to
words that are too rare to have a weight. Words or beginnings that stand mostly in texts of one grade
below the best mark it: a text that holds any is moved by one more weight of that grade, however many
it holds. A sum alone cannot place a middle grade both for one such word and for many. From the score
follow the expected grade and the probability of each tail, ``P(grade >= k)``.

The model is fitted on a bounded sample of the rated documents, at most ``SAMPLE_ROWS`` (least hash
of the id), on the driver; every document is scored, whole. A fifth of the sample is held out and
sets the cut from both sides: of the tail probabilities that all but ``SPARED`` of its best-graded
documents reach, one that the fewest others reach.

Null and empty texts have no words; they get the score of none. Without ratings, or with a single
grade, every document gets that grade (0 without any) and is kept. Repeated ratings count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import bound_batches
from textprep_spark.shipping import ship

SAMPLE_ROWS = 8000
SPARED = 0.01  # of the best-graded held-out documents may fall below the cut
MIN_TEXTS = 5  # of the sample, that a word must stand in to get a weight
MIN_DEVIATION = 5.0  # standard errors that the share of a grade among its texts must be off
MARKS = 0.5  # of the texts with a word that marks a grade have the grade, at least
BEGINNING = 5  # bytes of a longer word
DECAY = 1e-3  # with less, words of long texts that stand by chance make up for marks
STEPS, RATE = 150, 0.1
CACHED_WORDS = 300_000
EDGES = b".,;:!?\"'()[]|#*$%&<>"
RATES = ("upper", "marks", "symbols", "digits", "repeated", "few words")


def rates(words: list[bytes], times: Counter) -> list[float]:
    """Shares of a text's words, between 0 and 1."""
    n = len(words) or 1
    upper = marks = symbols = digits = 0
    for word, count in times.items():
        upper += count * (word.isupper() and len(word) > 1)
        marks += count * (b"!!" in word)
        symbols += count * (word[-1:] in b"#*$%&<>|")
        digits += count * any(48 <= c < 58 for c in word)
    repeated = n - len(times)
    return [upper / n, marks / n, symbols / n, digits / n, repeated / n, float(n < 50)]


def word_keys(word: bytes) -> list[int]:
    """The hashes of a word without the marks around it, ASCII letters lower-cased, and of its
    beginning."""
    plain = word.strip(EDGES).lower()
    keys = [xxhash.xxh3_64_intdigest(plain) >> 1]
    if len(plain) > BEGINNING:
        keys.append(xxhash.xxh3_64_intdigest(plain[:BEGINNING], seed=1) >> 1)
    return keys


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by word hash, marked grade and rate, and the ordered thresholds between grades."""

    weights: dict[int, float]
    marks: dict[int, int]  # the grade that a word hash marks
    mark_weights: tuple[float, ...]
    rate_weights: tuple[float, ...]
    thresholds: tuple[float, ...]
    cut: float  # of the highest tail probability

    def score(self, text: bytes | None, known: dict[bytes, tuple]) -> float:
        words = text.split() if text else []
        times = Counter(words)
        keys: dict[int, float] = {}
        for word in times:
            found = known.get(word)
            if found is None:
                own = [k for k in word_keys(word) if k in self.weights]
                found = known[word] = tuple((k, self.weights[k]) for k in own)
            if found:
                keys.update(found)
        marked = {self.marks[k] for k in keys if k in self.marks}
        rated = zip(rates(words, times), self.rate_weights)
        score = sum(keys.values()) + sum(self.mark_weights[g] for g in marked)
        return score + sum(r * w for r, w in rated)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return _sigmoid(scores[:, None] - np.array(self.thresholds)[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; the matrix is given by its entries, sorted by row."""
    top = int(grades.max())
    shares = np.cumsum(np.bincount(grades, minlength=top + 1))[:-1] / len(grades)
    first = np.log(shares / (1 - shares) + 1e-9)
    # thresholds as a first one and logarithms of the steps, so that they stay ordered
    state = np.concatenate([np.zeros(n), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    at = np.arange(len(grades))
    for step in range(1, STEPS + 1):
        weights, steps = state[:n], np.exp(state[n + 1 :])
        cuts = np.concatenate([[-np.inf], state[n] + np.concatenate([[0], np.cumsum(steps)]), [np.inf]])
        score = np.bincount(rows, weights=values * weights[columns], minlength=len(grades))
        below, above = _sigmoid(cuts[grades] - score), _sigmoid(cuts[grades + 1] - score)
        likely = np.maximum(above - below, 1e-12)
        d_below, d_above = below * (1 - below) / likely, above * (1 - above) / likely
        by_score = (d_above - d_below) / len(grades)
        gradient = np.zeros_like(state)
        gradient[:n] = np.bincount(columns, weights=values * by_score[rows], minlength=n)
        gradient[:n] += DECAY * weights
        by_cut = np.zeros((len(grades), top + 2))
        by_cut[at, grades] += d_below
        by_cut[at, grades + 1] -= d_above
        by_cut = by_cut.sum(axis=0)[1:-1] / len(grades)
        gradient[n] = by_cut.sum()
        for k in range(top - 1):
            gradient[n + 1 + k] = by_cut[k + 1 :].sum() * steps[k]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        state -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    cuts = state[n] + np.concatenate([[0], np.cumsum(np.exp(state[n + 1 :]))])
    return state[:n], cuts


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes and rates of sampled texts."""
    for batch in batches:
        keys, rated = [], []
        for text in batch["text"].to_pylist():
            words = text.split() if text else []
            times = Counter(words)
            keys.append(sorted({k for w in times for k in word_keys(w)}))
            rated.append(rates(words, times))
        yield pa.RecordBatch.from_arrays(
            [
                batch["order"],
                batch["grade"],
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(rated, pa.list_(pa.float64())),
            ],
            names=["order", "grade", "keys", "rates"],
        )


def fit(documents: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model from ``documents`` (doc_id, text) and ``ratings`` (doc_id, grade from 0)."""
    ship(documents.sparkSession)
    bound_batches(documents.sparkSession)
    sample = (
        ratings.where("doc_id is not null and grade is not null")
        .select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
        .withColumn("order", F.xxhash64("rated_id"))
        .orderBy("order", "rated_id", "grade")
        .limit(sample_rows)
    )
    texts = documents.select("doc_id", F.col("text").cast("binary"))
    found = texts.join(F.broadcast(sample), texts.doc_id == sample.rated_id)
    found = found.select("order", "grade", "text").mapInArrow(
        _entries, "order long, grade int, keys array<long>, rates array<double>"
    )
    table = found.toArrow().combine_chunks()
    keys = table["keys"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    keys = [k.values.to_numpy() for k in keys]
    given = (table["order"].to_pylist(), table["grade"].to_pylist(), keys, table["rates"].to_pylist())
    return fit_rows(sorted(zip(*given), key=lambda r: (r[0], r[1], r[2].tobytes())))


def fit_rows(rows: list[tuple]) -> OrdinalModel:
    """A model from (order, grade, sorted word hashes, rates) of each sampled document."""
    grades = np.array([r[1] for r in rows], dtype=np.int64)
    if len(set(grades.tolist())) < 2:
        top = int(grades.max()) if len(grades) else 0
        return OrdinalModel({}, {}, (0.0,) * top, (0.0,) * len(RATES), (-40.0,) * top, 0.0)
    top = int(grades.max())
    held = np.array([r[0] % 5 == 0 for r in rows])
    if len(set(grades[~held].tolist())) < top + 1:  # too few to hold any out
        held[:] = False
    fitted = [r for r, h in zip(rows, held) if not h]
    all_keys, which, texts_with = np.unique(
        np.concatenate([r[2] for r in fitted]), return_inverse=True, return_counts=True
    )
    # words whose texts are graded like any other would only add noise
    own, sizes = grades[~held], [len(r[2]) for r in fitted]
    deviation, marked = np.zeros(len(all_keys)), np.full(len(all_keys), -1)
    for g in np.unique(own):
        share, with_grade = (own == g).mean(), np.repeat((own == g).astype(float), sizes)
        sums = np.bincount(which, weights=with_grade, minlength=len(all_keys))
        spread = np.sqrt(texts_with * max(share * (1 - share), 1e-9))
        deviation = np.maximum(deviation, np.abs(sums - share * texts_with) / spread)
        if g < top:
            marked[_least_share(sums, texts_with) >= max(MARKS, share)] = g
    some = (texts_with >= MIN_TEXTS) & (deviation >= MIN_DEVIATION)
    keys, marks = all_keys[some], marked[some]
    n = len(keys) + top + len(RATES)

    def matrix(some: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = np.concatenate([r[2] for r in some])
        at = np.repeat(np.arange(len(some)), [len(r[2]) for r in some])
        column = np.searchsorted(keys, flat)
        column[column == len(keys)] = 0
        known = keys[column] == flat if len(keys) else np.zeros(len(flat), dtype=bool)
        at, column = at[known], column[known]
        marking = marks[column] >= 0
        holding = np.unique(at[marking] * top + marks[column[marking]])
        more = np.repeat(np.arange(len(some)), len(RATES))
        names = np.tile(np.arange(n - len(RATES), n), len(some))
        values = np.array([v for r in some for v in r[3]])
        return (
            np.concatenate([at, holding // top, more]),
            np.concatenate([column, len(keys) + holding % top, names]),
            np.concatenate([np.ones(len(at) + len(holding)), values]),
        )

    weights, cuts = fit_ordinal(*matrix(fitted), grades[~held], n)
    judged = [r for r, h in zip(rows, held) if h] or fitted
    at, column, values = matrix(judged)
    scores = np.bincount(at, weights=values * weights[column], minlength=len(judged))
    best = np.array([r[1] for r in judged]) == top
    tails = _sigmoid(scores - cuts[-1])
    weights = weights.tolist()
    return OrdinalModel(
        dict(zip(keys.tolist(), weights)),
        {k: g for k, g in zip(keys.tolist(), marks.tolist()) if g >= 0},
        tuple(weights[len(keys) : len(keys) + top]),
        tuple(weights[len(keys) + top :]),
        tuple(cuts.tolist()),
        choose_cut(tails[best], tails[~best]),
    )


def _least_share(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The lower end of Wilson's interval, two standard errors wide to each side."""
    share, z = hits / n, 4 / n
    return (share + z / 2 - np.sqrt(z * share * (1 - share) + z * z / 4)) / (1 + z)


def choose_cut(best: np.ndarray, others: np.ndarray) -> float:
    """Where at most ``SPARED`` of ``best`` fall below, and as many of ``others`` as then can;
    midway between the tails around it."""
    if not len(best):
        return 0.0
    best = np.sort(best)
    highest = best[int(SPARED * len(best))]
    caught = others[others < highest]
    if not len(caught):
        return float(best[0])
    most = caught.max()
    return float((most + best[np.searchsorted(best, most, side="right")]) / 2)


def grade(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, expected_grade, tail, kept): ``tail`` is the probability of the highest grade."""
    spark = documents.sparkSession
    ship(spark)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # words of a bounded sample

    def graded(texts: pa.Array) -> pa.Array:
        model, known = shared.value, {}
        scores = []
        for text in texts.to_pylist():
            if len(known) > CACHED_WORDS:
                known.clear()
            scores.append(model.score(text, known))
        tails = model.tails(np.array(scores, dtype=float))
        last = tails[:, -1] if tails.shape[1] else np.ones(len(tails))
        return pa.StructArray.from_arrays(
            [pa.array(tails.sum(axis=1)), pa.array(last)], names=["expected", "tail"]
        )

    score: Column = F.arrow_udf(graded, "struct<expected:double,tail:double>")(
        F.col("text").cast("binary")
    )
    scored = documents.select("doc_id", score.alias("graded"))
    return scored.select(
        "doc_id",
        F.col("graded.expected").alias("expected_grade"),
        F.col("graded.tail").alias("tail"),
        (F.col("graded.tail") >= model.cut).alias("kept"),
    )

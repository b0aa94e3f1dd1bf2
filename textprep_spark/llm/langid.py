"""Language identification by segmentation-marginalised unigrams.

The words of a text are its maximal runs of letters, lower-cased, each with a mark in front. Pieces
come from a fixed public vocabulary: those made of letters and the mark. A language gives every piece
a probability, and a word the sum, over all ways of cutting it into pieces, of the product of their
probabilities. The forward algorithm adds the cuts up in time linear in the word's length. A text's
words are independent; languages are compared by posterior, with the languages' shares of the
learned documents as prior.

Piece probabilities are learned by expectation maximisation over all labelled texts, without a
sample: Spark counts the words of each language once, then every round turns the counted words, in
parallel, into expected piece counts (forward and backward sums over each word's cuts), of which only
one sum per language and piece reaches the driver: languages times vocabulary, whatever the corpus.
A letter that is no piece of its own counts as the unknown piece.

``FittedLanguages.predict(text)`` is a column: a struct of the language and its posterior, 0 to 1,
rounded to 6 digits. Null and empty texts, texts without letters, and all texts if nothing was
learned, are ``und`` with score 0. Equal posteriors go to the first language by code point. Learning
skips rows without a text or a language; repeated rows count as often as they stand there. More than
``MOST_LANGUAGES`` different languages are an error, as the model would grow with them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep_spark.llm.common import bound_batches, stage
from textprep_spark.shipping import ship

MARK = "▁"  # in front of a word, as in the vocabulary
UNKNOWN = "und"
MOST_LANGUAGES = 1000
ROUNDS = 4
SMOOTHING = 0.05  # added to every expected count
LETTERS = 1 << 17  # the unknown piece stands for any of so many letters
SHORT = 32  # symbols up to which words are added up many at a time
SCALE = 1000.0  # per symbol, against underflow in short words
CACHED = 300_000  # words whose sums a Python worker remembers
CELLS = 1 << 20  # edges times languages handled at a time

_runs = re.compile(r"[^\W\d_]+").findall
_letters = regex.compile(r"\p{L}+").findall


def words_of(text: str | None) -> list[str]:
    """The words of a text, without their marks."""
    words = _runs(text.lower()) if text else []
    if words and not "".join(words).isalpha():  # numerals that are no digits
        words = [w for run in words for w in ([run] if run.isalpha() else _letters(run))]
    return words


def usable_pieces(pieces: list[str]) -> list[str]:
    """The pieces that can be part of a marked word, in their order."""
    found = []
    for piece in dict.fromkeys(pieces):
        rest = piece.removeprefix(MARK)
        if piece and (not rest or (rest.isalpha() and rest == rest.lower())):
            found.append(piece)
    return found


def read_pieces(vocabulary: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def characters(words: list[str]) -> np.ndarray:
    """(places, words): the characters of equally long words."""
    n = len(words[0])
    return np.array(words).view(np.uint32).reshape(len(words), n).T.astype(np.uint64)


class PieceTable:
    """Numbers of pieces by a 64-bit hash of their characters: open addressing, many at a time."""

    BITS = 18

    def __init__(self, pieces: list[str]):
        size = 1 << max(self.BITS, len(pieces).bit_length() + 3)
        self.shift = np.uint64(65 - size.bit_length())
        self.number = np.full(size + 64, -1, dtype=np.int32)
        self.hash = np.zeros(size + 64, dtype=np.uint64)
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for length in set(map(len, pieces)):
            same = [i for i, piece in enumerate(pieces) if len(piece) == length]
            codes = characters([pieces[i] for i in same])
            own = np.zeros(len(same), dtype=np.uint64)
            for row in codes:
                own = self.longer(own, row)
            hashes[same] = own
        for i, at in enumerate(self._slot(hashes).tolist()):
            while self.number[at] >= 0:
                at += 1
            self.number[at], self.hash[at] = i, hashes[i]

    @staticmethod
    def longer(hashes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """Hashes of strings that are one character longer."""
        return (hashes ^ (characters + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15) + (hashes >> np.uint64(29))

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 if there is none."""
        at = self._slot(hashes)
        found = self.number[at]
        wrong = (found >= 0) & (self.hash[at] != hashes)
        while wrong.any():
            at = at + wrong
            found = np.where(wrong, self.number[at], found)
            wrong &= (found >= 0) & (self.hash[at] != hashes)
        return found


class Lattices:
    """The cuts of words into pieces of a vocabulary, added up.

    ``chances`` (languages, pieces + 1): the last piece is the unknown one. Words bear their marks.
    """

    def __init__(self, pieces: list[str], chances: np.ndarray):
        self.id = {p: i for i, p in enumerate(pieces)}
        self.table = PieceTable(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.unknown, self.nothing = len(pieces), len(pieces) + 1
        # one piece more: what is no piece has no chance
        self.chance = np.hstack([chances, np.zeros((len(chances), 1))]).T.copy()
        self.chance[self.unknown] /= LETTERS

    def _edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, length, pieces) of all substrings of equally long words, as far as they are a
        piece of any of the words, shortest first."""
        n = len(words[0])
        codes = characters(words)
        hashes = np.zeros_like(codes)
        for length in range(1, min(n, self.longest) + 1):
            hashes = self.table.longer(hashes[: n - length + 1], codes[length - 1 :])
            found = self.table.find(hashes)
            found[found < 0] = self.unknown if length == 1 else self.nothing
            for start in np.flatnonzero((found != self.nothing).any(axis=1)).tolist():
                yield start, length, found[start]

    def _batches(self, words: list[str], width: int) -> Iterator[tuple]:
        """Equally long short words and their edges, by end, some words at a time."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= SHORT:
                by_length.setdefault(len(w), []).append(i)
        for n, members in by_length.items():
            step = max(1, CELLS // (n * min(n, self.longest) * width))
            for first in range(0, len(members), step):
                some = members[first : first + step]
                into: list[list] = [[] for _ in range(n + 1)]
                for start, length, ids in self._edges([words[i] for i in some]):
                    into[start + length].append((start, SCALE**length, ids))
                yield n, np.array(some), into

    def log_sums(self, words: list[str]) -> np.ndarray:
        """(words, languages): the logarithm of each word's probability."""
        languages = self.chance.shape[1]
        out = np.empty((len(words), languages))
        for n, members, into in self._batches(words, languages):
            ahead = np.zeros((n + 1, len(members), languages))
            ahead[0] = 1.0
            for end, edges in enumerate(into):
                for start, scale, ids in edges:
                    ahead[end] += ahead[start] * (self.chance[ids] * scale)
            out[members] = np.log(ahead[n]) - n * np.log(SCALE)
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self._long_forward(w)[len(w)]
        return out

    def expected(self, words: list[str], languages: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(languages, pieces + 1): how often each piece is expected in the words, each of which
        stands ``counts`` times in a text of its language."""
        shape = (self.chance.shape[1], self.nothing + 1)
        total, flat = np.zeros(shape[0] * shape[1]), self.chance.T.ravel()
        for n, members, into in self._batches(words, 2):
            of = languages[members] * shape[1]
            ahead, back = np.zeros((2, n + 1, len(members)))
            ahead[0] = back[n] = 1.0
            steps = [[(s, flat[of + ids] * scale, of + ids) for s, scale, ids in edges] for edges in into]
            for end, edges in enumerate(steps):
                for start, chance, _ in edges:
                    ahead[end] += ahead[start] * chance
            weight, places, shares = counts[members] / ahead[n], [], []
            for end in range(n, 0, -1):
                for start, chance, at in steps[end]:
                    passed = back[end] * chance
                    back[start] += passed
                    places.append(at)
                    shares.append(passed * ahead[start] * weight)
            total += np.bincount(np.concatenate(places), np.concatenate(shares), len(total))
        total = total.reshape(shape)
        for i, w in enumerate(words):
            if len(w) > SHORT:
                self._add_long(total[languages[i]], w, languages[i], counts[i])
        return total[:, :-1]

    def _long_chances(self, word: str, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end at a place of a long word: their ids and log chances, shortest first."""
        reach = range(1, min(end, self.longest) + 1)
        other = [self.unknown] + [self.nothing] * (len(reach) - 1)
        ids = np.array([self.id.get(word[end - k : end], o) for k, o in zip(reach, other)])
        with np.errstate(divide="ignore"):
            return ids, np.log(self.chance[ids])

    def _long_forward(self, word: str) -> np.ndarray:
        ahead = np.zeros((len(word) + 1, self.chance.shape[1]))
        for end in range(1, len(word) + 1):
            ids, chance = self._long_chances(word, end)
            ahead[end] = np.logaddexp.reduce(chance + ahead[end - 1 :: -1][: len(ids)], axis=0)
        return ahead

    def _add_long(self, total: np.ndarray, word: str, language: int, count: int) -> None:
        ahead = self._long_forward(word)[:, language]
        back = np.full(len(word) + 1, -np.inf)
        back[len(word)] = 0.0
        for end in range(len(word), 0, -1):
            ids, chance = self._long_chances(word, end)
            chance, starts = chance[:, language], end - 1 - np.arange(len(ids))
            share = np.exp(ahead[starts] + chance + back[end] - ahead[len(word)])
            np.add.at(total, ids, count * share)
            back[starts] = np.logaddexp(back[starts], chance + back[end])


class Scorer:
    """Posteriors of texts, with the sums of words remembered."""

    def __init__(self, model: Model):
        self.lattices = Lattices(model.pieces, model.chances)
        self.languages, self.prior = model.languages, np.log(model.shares)
        self.row: dict[str, int] = {}
        self.sums = np.empty((0, len(self.languages)))

    def _learn(self, met: set[str]) -> None:
        if len(self.row) > CACHED:
            known = [w for w in met if w in self.row]
            self.sums = self.sums[[self.row[w] for w in known]]
            self.row = {w: i for i, w in enumerate(known)}
        new = sorted(met.difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
            self.sums = np.vstack([self.sums, self.lattices.log_sums([MARK + w for w in new])])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cut = [words_of(t) for t in texts]
        self._learn(set().union(*cut))
        of, languages, scores = self.row.__getitem__, [], []
        for words in cut:
            if not words:
                languages.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.prior + self.sums[np.fromiter(map(of, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            languages.append(self.languages[best])
            scores.append(round(float(1 / np.exp(total - total[best]).sum()), 6))
        return languages, scores


@dataclass(frozen=True)
class Model:
    """What is learned: sizes are bounded by languages and vocabulary."""

    languages: list[str]
    shares: np.ndarray  # of the learned documents
    pieces: list[str]
    chances: np.ndarray  # (languages, pieces + 1)


@lru_cache(maxsize=2)
def _scorer(model: Broadcast) -> Scorer:
    return Scorer(model.value)


@dataclass(frozen=True)
class FittedLanguages:
    model: Model
    spark: SparkSession

    def predict(self, text: Column) -> Column:
        """struct<lang: string, score: double> of a text column; only the text enters Python."""
        shipped = self.spark.sparkContext.broadcast(self.model)

        def score(texts: pa.Array) -> pa.Array:
            scorer, languages, scores = _scorer(shipped), [], []
            for start in range(0, len(texts), 256):
                found = scorer.score(texts[start : start + 256].to_pylist())
                languages += found[0]
                scores += found[1]
            return pa.StructArray.from_arrays(
                [pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"]
            )

        return F.arrow_udf(score, "struct<lang:string,score:double>")(text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for language, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            found.setdefault(language, Counter()).update(words_of(text))
        for language, words in found.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language] * len(words), pa.string()),
                    pa.array(list(words), pa.string()),
                    pa.array(list(words.values()), pa.int64()),
                ],
                names=["lang", "word", "n"],
            )


def _starting(languages: int, pieces: int) -> np.ndarray:
    return np.full((languages, pieces + 1), 1.0 / (pieces + 1))


def fit(labelled: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> FittedLanguages:
    """Learn piece probabilities from ``labelled`` (text, lang)."""
    spark = labelled.sparkSession
    ship(spark)
    bound_batches(spark)
    pieces = usable_pieces(read_pieces(vocabulary))
    known = labelled.where("text is not null and lang is not null").select("lang", "text")
    documents = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1)
    shares = {r["lang"]: r["n"] for r in documents.collect()}
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(shares)
    share = np.array([shares[x] for x in languages], dtype=float)
    share /= max(share.sum(), 1)
    chances = _starting(len(languages), len(pieces))
    if not languages:
        return FittedLanguages(Model(languages, share, pieces, chances), spark)
    words = known.mapInArrow(_counted, "lang string, word string, n long")
    words = stage(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(Model(languages, share, pieces, chances))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shipped.value
            lattices = Lattices(model.pieces, model.chances)
            number = {x: i for i, x in enumerate(model.languages)}
            total = np.zeros(model.chances.shape)
            for batch in batches:
                of = np.array([number[x] for x in batch["lang"].to_pylist()], dtype=np.int64)
                marked = [MARK + w for w in batch["word"].to_pylist()]
                total += lattices.expected(marked, of, batch["n"].to_numpy())
            language, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(language), pa.array(piece), pa.array(total[language, piece])],
                names=["language", "piece", "n"],
            )

        expected = words.mapInArrow(expect, "language long, piece long, n double")
        sums = expected.groupBy("language", "piece").agg(F.sum("n").alias("n"))
        rows = sums.toArrow()  # languages times pieces, at most
        total = np.full(chances.shape, SMOOTHING)
        total[rows["language"].to_numpy(), rows["piece"].to_numpy()] += rows["n"].to_numpy()
        chances = total / total.sum(axis=1, keepdims=True)
        shipped.unpersist()
    return FittedLanguages(Model(languages, share, pieces, chances), spark)

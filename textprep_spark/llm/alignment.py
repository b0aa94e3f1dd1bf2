"""Alignment of two tokenizers' tokens over the same bytes.

A byte-level BPE (A, a ``tokenizers`` file) reads a space and the text; a sentencepiece model (B) reads
the text and puts the space in front itself. Where a token of each ends at the same byte, the text is
cut; between two cuts lies a group of A's tokens and one of B's, and the two that end at the cut are
linked.

Coarse cuts come from what the libraries tell: A's offsets count characters, B's spans bytes of
the text. Both are vague inside a character of several bytes: all of A's
tokens that share a character report the whole of it, and of B's byte-fallback tokens all but the last
report nothing. There the decoded bytes of the tokens decide: within such a run, every token ends as
many bytes behind the one before as it has bytes.

Neither tokenizer looks across the start of a space or line feed that stands between two characters
other than white space: A's pieces begin there, and none of B's holds an inner space mark or a line feed,
which is verified, as is A's way of splitting; otherwise a text is one unit. So a text is cut into units
there, each of which is aligned once and remembered; many new ones are put end to end and aligned in
one pass.

A full stop or comma behind a Latin letter is a piece of its own for A, and none of B's pieces holds such
a pair, which is verified. So a new word that ends in one is put together from the word and the mark.

A text whose tokens do not give back its bytes has no tokens, nor has a null or empty one.

Links are counted over the corpus. Texts are read once: every batch is staged as its texts, written as
unit numbers, and the links of its units. Of these, the distinct ones of a batch are counted before
anything is shuffled; the sums go back to the batches in which a link occurs, not to the texts. A batch
is bounded by bytes, so is what one task holds at a time.

``align(documents)`` returns one row per row; repeated ids are rows of their own, a null doc_id is kept.
Empty tables give an empty result. Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import bound_batches, stage
from textprep_spark.shipping import ship

MARK = "▁"
CACHED = 200_000  # units in each of the two generations that a Python worker remembers
GROUP = 1 << 19  # characters of texts that are cut at a time
BATCH = 6 << 20  # characters of texts whose links are counted together
TOGETHER = 1 << 19  # characters of new units that are aligned in one pass
MARKS = ".,"
LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_marked = re.compile(rf".*{LETTER}[{MARKS}]", re.DOTALL).fullmatch
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for
    themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def char_ends(text: str) -> np.ndarray:
    """The byte at which each character of a text begins, and the text's end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.concatenate([[0], np.cumsum(sizes)])


def _spans(told: list[tuple[int, int]]) -> np.ndarray:
    """Starts and ends."""
    return np.fromiter(chain.from_iterable(told), dtype=np.int64, count=2 * len(told)).reshape(-1, 2).T


def refined(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
    """The byte ends of tokens with coarse spans (in bytes) and ``sizes`` of decoded bytes; None if
    the two disagree.

    A token's coarse end is sure if it reports a span of its own in which the next one has no part;
    between sure ends, sizes are added up, and must lead to the next sure one.
    """
    n = len(ends)
    sure = ends > starts
    sure[:-1] &= starts[1:] >= ends[:-1]
    if not n or not sure[-1]:
        return None
    summed = np.cumsum(sizes)
    at = np.flatnonzero(sure)
    if (np.diff(ends[at], prepend=0) != np.diff(summed[at], prepend=0)).any():
        return None
    before = np.searchsorted(at, np.arange(n))  # the first sure end at or behind each token
    base = np.concatenate([[0], ends[at]])[before]
    passed = np.concatenate([[0], summed[at]])[before]
    return base + summed - passed


# units: white space of one character is cut in front of, if it is a space or a line feed
_units = re.compile(
    r"\A\s++\Z|(?:\A\s++|[ \n])\S++(?:(?:\s\s++|[^\S \n])\S++)*+(?:\s++\Z)?"
).findall


@dataclass(frozen=True)
class Aligned:
    """Tokens of a text by group: ids, and the index behind each group's last token."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray  # bytes


class Tokenizers:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in vocabulary.items():
            if all(c in alphabet for c in token):
                self.a_bytes[i] = bytes(map(alphabet.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        told = json.loads(a_file)
        way = told.get("pre_tokenizer") or {}
        self.local = (
            told.get("normalizer") is None
            and way.get("type") == "ByteLevel"
            and way.get("use_regex") is True
            and not way.get("add_prefix_space")
            and not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)
        )
        self.marks_apart = self.local and not any(re.search(f"{LETTER}[{MARKS}]", p) for p in pieces)

    def align(self, text: str) -> Aligned | None:
        """The groups of a text that begins with a space; None if its tokens are not its bytes."""
        whole = text.encode()
        coded = self.a.encode(text, add_special_tokens=False)
        a = np.array(coded.ids, dtype=np.int64)
        ends = char_ends(text)
        a_starts, a_stops = _spans(coded.offsets)
        told = self.b.encode(whole[1:], return_type="offset_mapping")  # of bytes, so spans count bytes
        b = np.array(told["ids"], dtype=np.int64)
        b_starts, b_stops = _spans(told["offsets"])
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole:
            return None
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return None
        at_a = refined(ends[a_starts], ends[a_stops], self.a_sizes[a])
        # spans count the text's bytes: one less than here, but that the space in front starts at 0
        starts = np.where(np.arange(len(b)) > 0, b_starts + 1, 0)
        at_b = refined(starts, b_stops + 1, self.b_sizes[b])
        if at_a is None or at_b is None:  # spans that do not fit the bytes: the bytes alone decide
            at_a, at_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        cuts, of_a, of_b = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
        return Aligned(a, b, of_a + 1, of_b + 1, cuts)

    def units(self, text: str) -> list[str]:
        """A space and the text, cut where neither tokenizer looks across."""
        return _units(" " + text) if self.local else [" " + text]


class Units:
    """Aligned units, remembered by number: how many tokens of A and B each has (-1 if they are not
    its bytes), its groups as text, and its links."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        a, b = ([str(i).encode() for i in range(len(x))] for x in (tokenizers.a_bytes, tokenizers.b_bytes))
        # a link in as few bytes as the vocabularies allow
        self.code = np.dtype(np.uint32 if max(len(a), len(b)) <= 1 << 16 else np.uint64)
        told = [x + mark for ids, marks in ((a, (b",", b"|")), (b, (b",", b";"))) for mark in marks for x in ids]
        self.told = np.empty(len(told), dtype=object)
        self.told[:] = told
        self.told_sizes = np.array([len(x) for x in told])
        self.n_a = len(a)
        self.n_b = len(b)
        self._begin()
        self.before = self._all()

    def _begin(self) -> None:
        self.known: dict[str, int] = {}
        self.a: list[int] = []
        self.b: list[int] = []
        self.groups: list[bytes] = []
        self.links: list[bytes] = []
        # marks behind a letter; units of texts begin with white space
        self.marks = self.tokenizers.marks_apart and all([self._keep([" a", m], f" a{m}", 0) for m in MARKS])

    def _all(self) -> tuple:
        return self.known, self.a, self.b, self.groups, self.links

    def forget(self) -> None:
        """Drop what has not been met for long: of two generations, the older one."""
        if len(self.known) > CACHED:
            self.before = self._all()
            self._begin()

    def _add(self, units: list[str], *columns: Iterable) -> None:
        self.known.update(zip(units, range(len(self.a), len(self.a) + len(units))))
        for own, new in zip((self.a, self.b, self.groups, self.links), columns):
            own.extend(new)

    def _add_unsound(self, unit: str) -> None:
        self._add([unit], [-1], [-1], [b""], [b""])

    def _keep(self, units: list[str], text: str, skipped: int) -> bool:
        """Remember the units that make up ``text`` behind its first ``skipped`` bytes, if its tokens
        are its bytes."""
        found = self.tokenizers.align(text)
        if found is None:
            return False
        of_units = np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)))
        ends = char_ends(text)[skipped + of_units]  # what is skipped are characters of one byte
        upto = np.searchsorted(found.cuts, [skipped, *ends], side="right") if skipped else np.concatenate(
            [[0], np.searchsorted(found.cuts, ends, side="right")]
        )
        if (found.cuts[upto[1:] - 1] != ends).any() or (skipped and found.cuts[upto[0] - 1] != skipped):
            raise ValueError("a token reaches over the end of a unit")
        # tokens in the order in which groups are told: A's of a group, then B's
        of_a = np.searchsorted(found.a_ends, np.arange(len(found.a)), side="right")
        of_b = np.searchsorted(found.b_ends, np.arange(len(found.b)), side="right")
        told = np.empty(len(found.a) + len(found.b), dtype=np.int64)
        a = found.a.copy()
        a[found.a_ends - 1] += self.n_a
        b = found.b + 2 * self.n_a
        b[found.b_ends - 1] += self.n_b
        told[np.arange(len(a)) + np.concatenate([[0], found.b_ends])[of_a]] = a
        told[np.arange(len(b)) + found.a_ends[of_b]] = b
        sizes = np.concatenate([[0], np.cumsum(self.told_sizes[told])])
        whole = b"".join(self.told[told].tolist())
        half, width = 4 * self.code.itemsize, self.code.itemsize
        links = ((found.a[found.a_ends - 1] << half) | found.b[found.b_ends - 1]).astype(self.code).tobytes()
        upto_a, upto_b = (np.concatenate([[0], e])[upto] for e in (found.a_ends, found.b_ends))
        told_upto, links_upto = sizes[upto_a + upto_b], (width * upto).tolist()
        self._add(
            units,
            np.diff(upto_a).tolist(),
            np.diff(upto_b).tolist(),
            # without the mark behind the last group
            [whole[i:j] for i, j in zip(told_upto[:-1].tolist(), (told_upto[1:] - 1).tolist())],
            [links[i:j] for i, j in zip(links_upto, links_upto[1:])],
        )
        return True

    def _learn(self, units: list[str]) -> None:
        """Align units end to end, behind one of our own; halve what is not its tokens' bytes."""
        if not self._keep(units, " ." + "".join(units), 2):
            if len(units) == 1:
                self._add_unsound(units[0])
                return
            self._learn(units[: len(units) // 2])
            self._learn(units[len(units) // 2 :])

    def _add_marked(self, units: list[str]) -> None:
        """Put together units whose word is known to be its bytes."""
        word, mark = ([self.known[u[x]] for u in units] for x in (slice(-1), -1))
        for column, between in ((self.a, 0), (self.b, 0), (self.groups, b";"), (self.links, b"")):
            column.extend([column[i] + between + column[j] for i, j in zip(word, mark)])
        self.known.update(zip(units, range(len(self.a) - len(units), len(self.a))))

    def learn(self, met: set[str]) -> None:
        new = self._recalled(met)
        marked = [u for u in new if u[-1] in MARKS and _marked(u)] if self.marks and self.tokenizers.local else []
        new.difference_update(marked)
        self._learn_all(new | self._recalled({u[:-1] for u in marked}))
        sound = [u for u in marked if self.a[self.known[u[:-1]]] >= 0]
        self._add_marked(sound)
        self._learn_all(set(marked).difference(sound))

    def _recalled(self, met: set[str]) -> set[str]:
        """The units that the older generation does not know either; what it knows is taken over."""
        known, *columns = self.before
        new = met.difference(self.known)
        again = list(new.intersection(known))
        at = [known[unit] for unit in again]
        self._add(again, *[map(c.__getitem__, at) for c in columns])
        return new.difference(again)

    def _learn_all(self, new: set[str]) -> None:
        some, size = [], 0
        for unit in sorted(new):
            if not self.tokenizers.local:
                if not self._keep([unit], unit, 0):
                    self._add_unsound(unit)
            elif unit[-1].isspace():  # it ends its text; white space behind it would change it
                self._learn([unit])
            else:
                some.append(unit)
                size += len(unit)
                if size >= TOGETHER:
                    self._learn(some)
                    some, size = [], 0
        if some:
            self._learn(some)


@lru_cache(maxsize=2)
def _remembered(files: Broadcast) -> Units:
    return Units(Tokenizers(*files.value))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in any order as ascending steps, byte planes apart, which compress well."""
    steps = np.diff(np.sort(numbers), prepend=0).astype(np.uint32)
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.int64)


ROWS = pa.schema(
    [
        ("batch", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("units", pa.binary()),  # of a text
        ("per_unit", pa.binary()),  # of the batch, in a row of its own: links of each unit,
        ("times", pa.binary()),  # how often the unit occurs,
        ("links", pa.binary()),  # and the links
    ]
)


def _runs(texts: list[str | None], characters: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    start = size = 0
    for i, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= characters or i == len(texts):
            yield start, i
            start, size = i, 0


def _aligned(units: Units, batch: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of one batch: one for each text, and one for its units."""
    units.forget()
    at, told, number, groups = [], [], units.known.__getitem__, units.groups
    for start, stop in _runs(texts, GROUP):
        cut = [units.tokenizers.units(t) if t else [] for t in texts[start:stop]]
        units.learn(set().union(*cut))
        for own in cut:
            own = list(map(number, own))
            told.append(hashlib.sha256(b";".join(map(groups.__getitem__, own))).hexdigest())
            at.append(np.array(own, dtype=np.int32))
    n_a, n_b = np.array(units.a, dtype=np.int64), np.array(units.b, dtype=np.int64)
    n_links = np.fromiter(map(len, units.links), dtype=np.int64, count=len(units.links)) // units.code.itemsize
    sound = [len(own) > 0 and bool((n_a[own] >= 0).all()) for own in at]
    met = [own for own, s in zip(at, sound) if s]
    times = np.bincount(np.concatenate(met) if met else np.empty(0, dtype=np.int32), minlength=len(n_a))
    used = np.flatnonzero(times)
    local = np.cumsum(times > 0) - 1
    rows = []
    for doc_id, own, s, groups_told in zip(ids, at, sound, told):
        if not s:
            rows.append((batch, doc_id, 0, 0, 0, "", b"", None, None, None))
            continue
        sums = (int(x[own].sum()) for x in (n_a, n_b, n_links))
        rows.append((batch, doc_id, *sums, groups_told, packed(local[own]), None, None, None))
    links = b"".join([units.links[i] for i in used.tolist()])
    per_unit = n_links[used].astype(np.uint32)
    rows.append((batch, *[None] * 6, per_unit.tobytes(), times[used].astype(np.uint32).tobytes(), links))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)


def _codes(links: bytes, per_unit: np.ndarray) -> np.ndarray:
    """The links of a batch's units as 64-bit codes: the ids of A and B in the two halves."""
    n = int(per_unit.sum())
    if not n or len(links) == 8 * n:
        return np.frombuffer(links, dtype=np.int64)
    codes = np.frombuffer(links, dtype=np.uint32).astype(np.int64)
    return ((codes >> 16) << 32) | (codes & 0xFFFF)


def _batch_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct links of each batch, and how often they occur there."""
    for rows in batches:
        for batch, per_unit, times, links in zip(*(rows[c].to_pylist() for c in ("batch", "per_unit", "times", "links"))):
            per_unit = np.frombuffer(per_unit, dtype=np.uint32)
            codes = _codes(links, per_unit)
            each = np.repeat(np.frombuffer(times, dtype=np.uint32), per_unit)
            distinct, at = np.unique(codes, return_inverse=True)
            counts = np.bincount(at, each, len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(distinct), batch)), pa.array(distinct), pa.array(counts)],
                names=["batch", "link", "n"],
            )


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _judged(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """The texts of one batch, with the corpus counts of its links."""
    _remembered.cache_clear()  # all texts are aligned by now
    texts = rows.filter(pa.compute.is_null(rows["per_unit"]))
    of_batch = rows.filter(pa.compute.is_valid(rows["per_unit"]))
    best_of = sum_of = np.zeros(0, dtype=np.int64)
    if len(counts):
        per_unit = np.frombuffer(of_batch["per_unit"][0].as_py(), dtype=np.uint32)
        codes = _codes(of_batch["links"][0].as_py(), per_unit)
        link = counts["link"].to_numpy()
        order = np.argsort(link)
        at = order[np.searchsorted(link[order], codes)]
        # every unit holds a link, its last
        starts = np.cumsum(per_unit, dtype=np.int64) - per_unit
        best_of = np.add.reduceat(counts["best"].to_numpy()[at].astype(np.int64), starts)
        sum_of = np.add.reduceat(counts["n"].to_numpy()[at], starts)
    units = [unpacked(u) for u in texts["units"].to_pylist()]
    return pa.table(
        {
            "doc_id": texts["doc_id"],
            "n_a": texts["n_a"],
            "n_b": texts["n_b"],
            "n_groups": texts["n_links"],
            "n_links": texts["n_links"],
            "n_best": pa.array([int(best_of[u].sum()) for u in units], pa.int64()),
            "count_sum": pa.array([int(sum_of[u].sum()) for u in units], pa.int64()),
            "groups_sha256": texts["groups_sha256"],
        }
    )


def align(documents: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``documents``
    (doc_id, text), aligned by the ``tokenizers`` file ``byte_level`` and the sentencepiece model
    ``pieces``.

    The groups are told as ``a1,a2|b1;a3|b2,b3`` and hashed. A link's count is how often its two ids are
    linked in the corpus; it is among the best if no other link of its B id has a higher one.
    """
    spark = documents.sparkSession
    ship(spark)
    bound_batches(spark)
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part = _remembered(files), TaskContext.get().partitionId()
        number = part << 32
        for batch in batches:
            ids, texts = (batch[c].to_pylist() for c in ("doc_id", "text"))
            for start, stop in _runs(texts, BATCH):
                yield _aligned(units, number, ids[start:stop], texts[start:stop])
                number += 1

    texts = documents.select(F.col("doc_id").cast("long"), "text")
    # a batch's number is that of the written table: a task that runs again writes anew
    schema = (
        "batch long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, "
        "units binary, per_unit binary, times binary, links binary"
    )
    rows = stage(texts.mapInArrow(aligned, schema), "aligned")
    of_batches = rows.where("per_unit is not null").select("batch", "per_unit", "times", "links")
    linked = stage(of_batches.mapInArrow(_batch_links, "batch long, link long, n long"), "batch-links")
    counts = linked.groupBy("link").agg(F.sum("n").alias("n"))
    counts = stage(counts.withColumn("b", F.col("link").bitwiseAND(F.lit((1 << 32) - 1))), "link-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each of B's ids, at most
    counts = counts.join(F.broadcast(highest), "b").select("link", "n", (F.col("n") == F.col("highest")).alias("best"))
    told = linked.select("batch", "link").join(counts, "link")
    rows = rows.drop("times")
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_judged, RESULT)

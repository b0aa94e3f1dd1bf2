"""Byte-level BPE encoding and decoding with the ranks of a given vocabulary file.

A text is cut into pieces by a pattern; every piece is merged on its own. The merges of one piece
are driven by a segment tree over its byte positions. A leaf holds the rank of the pair that starts
at its position, an inner node the least of its two children, so the root names the leftmost pair of
least rank. A merge joins two neighbours of a linked list of live positions and touches three
leaves, each a logarithmic climb: a piece of n bytes takes O(n log n), also when a text is one
piece of a megabyte.

Null texts encode as the empty text: no ids. Null ids decode to no bytes. Texts are encoded whole
and without special tokens: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textprep_spark.llm.common import bound_batches
from textprep_spark.shipping import ship

CACHED = 300_000  # words and pieces a Python worker remembers, each; then those not just met go
CACHED_CHARS = 64  # longer ones are not remembered
WIDTHS = (8, 16, 32, 64)  # pieces up to these lengths are merged many at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(None, lines))}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    none = len(ranks) * n + n  # above every key
    after = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))  # where the token in front of it starts
    width = 1
    while width < n - 1:
        width *= 2
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[width + i] = rank * n + i  # equal ranks: the leftmost is least
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, key: int) -> None:
        node = width + i
        tree[node] = key
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            least = key if key < other else other
            if tree[node] == least:
                return
            tree[node] = key = least

    def pair(i: int) -> int:
        """The key of the pair that starts at i."""
        second = after[i]
        if second >= n:
            return none
        rank = ranks.get(piece[i : after[second]])
        return none if rank is None else rank * n + i

    while tree[1] < none:
        i = tree[1] % n
        gone = after[i]
        after[i] = end = after[gone]
        if end < n:
            before[end] = i
        if gone < n - 1:
            put(gone, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def _packed(ids) -> bytes:
    return np.asarray(ids, dtype=np.int32).tobytes()


class PairRanks:
    """Ranks of pairs of ids, for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.step = max(ranks.values()) + 1
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.step + right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the two do not join."""
        if not len(self.keys):
            return np.full(left.shape, -1, dtype=np.int64)
        wanted = left * self.step + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], -1)


def merge_pieces(
    pieces: list[bytes], width: int, of_byte: np.ndarray, ranks: PairRanks
) -> list[bytes]:
    """The packed ids of many pieces of 2 to ``width`` bytes (a power of two), by one segment tree each.

    The same as ``merge_piece``, one merge of every unfinished piece per round.
    """
    many, none = len(pieces), np.iinfo(np.int64).max
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
    token = of_byte[raw].reshape(many, width)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=many)
    place = np.arange(width)
    after = np.tile(place + 1, (many, 1))
    before = np.tile(place - 1, (many, 1))
    tree = np.full((many, 2 * width), none, dtype=np.int64)

    rank = ranks(token[:, :-1], token[:, 1:])
    joins = (rank >= 0) & (place[1:] < length[:, None])
    tree[:, width:-1][joins] = (rank * width + place[:-1])[joins]
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(rows: np.ndarray, leaf: np.ndarray, key: np.ndarray) -> None:
        node = leaf + width
        tree[rows, node] = key
        for _ in range(width.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        inside = second < length[rows]
        rank = ranks(token[rows, first], token[rows, np.where(inside, second, 0)])
        return np.where(inside & (rank >= 0), rank * width + first, none)

    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        best = tree[rows, 1]
        at = best % width
        gone = after[rows, at]
        end = after[rows, gone]
        token[rows, at] = best // width
        after[rows, at] = end
        more = end < length[rows]
        before[rows[more], end[more]] = at[more]
        put(rows, gone, np.full(len(rows), none))
        put(rows, at, pair(rows, at, end))
        front = before[rows, at]
        some = front >= 0
        put(rows[some], front[some], pair(rows[some], front[some], at[some]))
        rows = rows[tree[rows, 1] < none]

    starts = np.zeros((many, width), dtype=bool)
    here, rows = np.zeros(many, dtype=np.int64), np.arange(many)
    while len(rows):
        starts[rows, here] = True
        here = after[rows, here]
        open_ = here < length[rows]
        rows, here = rows[open_], here[open_]
    ids = _packed(token[starts])
    ends = (4 * np.cumsum(starts.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts; remembers the ids of words and pieces it has met.

    Where white space follows another character, a piece ends, whatever stands around it. So texts
    are cut there first, and what lies between two cuts is encoded once and remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        if len(set(ranks.values())) != len(ranks):
            raise ValueError("two tokens have the same rank")
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        white = "".join(c for c in map(chr, range(1 << 16)) if regex.match(r"\s", c))
        self.chunks = re.compile(f"[{white}]*[^{white}]+|[{white}]+").findall
        self.bytes = {i: token for token, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = PairRanks(ranks)
        self.words: dict[str, bytes] = {}  # between two cuts
        self.pieces: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Merge pieces that are not remembered, short ones many at a time."""
        short: dict[int, list[str]] = {w: [] for w in WIDTHS}
        for piece in pieces:
            raw = piece.encode()
            width = next((w for w in WIDTHS if len(raw) <= w), None)
            if width is None or raw in self.ranks:
                self.pieces[piece] = _packed(merge_piece(raw, self.ranks))
            else:
                short[width].append(piece)
        for width, some in short.items():
            for start in range(0, len(some), 1 << 14):
                part = some[start : start + (1 << 14)]
                merged = merge_pieces(
                    [p.encode() for p in part], width, self.of_byte, self.pairs
                )
                self.pieces.update(zip(part, merged))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as 4-byte integers in a row."""
        cut = [self.chunks(t) for t in texts]
        met = set(chain.from_iterable(cut))
        if len(self.words) > CACHED:
            self.words = {c: self.words[c] for c in met.intersection(self.words)}
        new = met.difference(self.words)
        found = {chunk: self.find(chunk) for chunk in new}
        met = set(chain.from_iterable(found.values()))
        if len(self.pieces) > CACHED:
            self.pieces = {p: self.pieces[p] for p in met.intersection(self.pieces)}
        pieces = met.difference(self.pieces)
        self._learn(pieces)
        of_piece, words = self.pieces.__getitem__, self.words
        for chunk, parts in found.items():
            words[chunk] = b"".join(map(of_piece, parts))
        out = [b"".join(map(words.__getitem__, chunks)) for chunks in cut]
        for known, added in ((self.words, new), (self.pieces, pieces)):
            for long in [x for x in added if len(x) > CACHED_CHARS]:
                del known[long]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def _codec(content: Broadcast, pattern: str) -> Codec:
    return Codec(content.value, pattern)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about a million characters: bounds what is held besides the batch."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= 1 << 20:
            yield group
            group, size = [], 0
    yield group


def _list_array(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
    flat = np.frombuffer(b"".join(packed), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _decoded(codec: Codec, ids: pa.Array) -> pa.Array:
    flat = ids.flatten().to_numpy()
    ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
    return pa.array(
        [codec.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)], pa.binary()
    )


@dataclass(frozen=True)
class ByteBpe:
    """Column functions; make one with ``byte_bpe``.

    ``encode(text) -> array<int>``, ``decode(ids) -> binary``, and ``round_trip(text)``, a struct
    of the ids and the bytes that decoding them gives, for one pass through Python.
    """

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    round_trip: Callable[[Column], Column]


def byte_bpe(spark: SparkSession, vocabulary: str, pattern: str) -> ByteBpe:
    """The codec of a vocabulary file and of the pattern that cuts texts into pieces.

    The driver reads the file and broadcasts its ranks, whose number is fixed, so the executors
    need no copy of it. Ids that the vocabulary lacks make ``decode`` fail.
    """
    ship(spark)
    bound_batches(spark)
    content = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def encode(texts: pa.Array) -> pa.Array:
        codec, out = _codec(content, pattern), []
        for group in _groups([t or "" for t in texts.to_pylist()]):
            out += codec.encode_all(group)
        return _list_array(out)

    def decode(ids: pa.Array) -> pa.Array:
        return _decoded(_codec(content, pattern), ids)

    def round_trip(texts: pa.Array) -> pa.Array:
        ids = encode(texts)
        return pa.StructArray.from_arrays([ids, decode(ids)], names=["ids", "decoded"])

    return ByteBpe(
        F.arrow_udf(encode, "array<int>"),
        F.arrow_udf(decode, "binary"),
        F.arrow_udf(round_trip, "struct<ids:array<int>,decoded:binary>"),
    )

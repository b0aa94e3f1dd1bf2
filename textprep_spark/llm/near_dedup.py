"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is the five-word shingles of its text, ASCII letters lower-cased; with fewer words
the whole sequence is one shingle. Documents with equal sets are one class, represented by its least
id; only representatives go on.

1. Banded signatures propose candidates: 32 bands of 4 hashes find a pair of similarity 0.75 with
   probability 1 - 5e-6, and pairs of more similar documents more surely.
2. A candidate pair's signatures are compared in batches of 32 hashes. After each batch the pair is
   dropped if, given the matches so far, its similarity reaches the threshold with a posterior
   probability below ``MISS``.
3. Survivors are confirmed on their full sets.

Buckets can hold a third of all rows, so their pairs are never listed. Each member is first
compared with the bucket's least member only, in the first ``FIRST_BANDS`` bands, then, if the two
are not connected by that, in the others. Afterwards most buckets lie within one component and need
nothing more; in the others, members of different components are compared block by block, two
blocks of some hundred members in a task, which returns links only. Every pair of a bucket is so
either compared or known to be connected, and no link between components is lost.

Documents without words, null or empty, have empty sets and link with nothing. A null doc_id links
with nothing, too. Repeated rows of a document are rows of one class; rows of one id with different
texts are compared each for itself. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import bound_batches, release, stage
from textprep_spark.llm.components import components
from textprep_spark.shipping import ship

SHINGLE = 5
PERCENT = 75  # similarity of a link, at least
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
FIRST_BANDS = 4
BATCH = 32  # hashes compared at a time
MISS = 1e-4  # posterior probability below which a candidate is dropped
BLOCK = 256  # members of a bucket compared at a time
BROADCAST_IDS = 2_000_000  # ids of texts to read again that are broadcast, at most
CACHED_WORDS = 150_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, start: int) -> np.ndarray:
    return _mixed(np.arange(start, start + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_PLACE = _constants(SHINGLE + 1, 1) | np.uint64(1)
_TIMES = _constants(HASHES, 101) | np.uint64(1)
_PLUS = _constants(HASHES, 1001)
_BAND = _constants(ROWS, 5001) | np.uint64(1)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _Words()


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = text.lower().split() if text else []  # of bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    size = min(n, SHINGLE)
    sums = np.full(n - size + 1, size, dtype=np.uint64) * _PLACE[SHINGLE]
    for k in range(size):
        sums += hashes[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(_mixed(sums))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set that is not empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024]
        values = _TIMES[:, None] * part[None, :] + _PLUS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key for each band of each signature."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    numbers = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mixed((_mixed(parts * _BAND) * _BAND).sum(axis=2) + numbers).astype(np.int64)


def least_matches(miss: float = MISS) -> list[int]:
    """For each number of hashes compared, the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n make the similarity Beta(m + 1, n - m + 1), whose upper
    tail is a sum of binomial terms.
    """
    t = PERCENT / 100

    def tail(m: int, n: int) -> float:
        terms = (math.comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
        return sum(terms)

    return [
        next(m for m in range(n + 1) if tail(m, n) >= miss)
        for n in range(BATCH, HASHES + 1, BATCH)
    ]


def _survive(
    compare: Callable[[np.ndarray, int, int], np.ndarray], pairs: int
) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the pairs that no batch drops, and how many hashes of theirs match.

    ``compare`` counts matches in a batch.
    """
    left, matches = np.arange(pairs), np.zeros(pairs, dtype=np.int64)
    for i, least in enumerate(least_matches()):
        matches += compare(left, i * BATCH, (i + 1) * BATCH)
        going = matches >= least
        left, matches = left[going], matches[going]
    return left, matches


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _class(shingles: bytes) -> bytes:
    """What documents with equal sets have in common."""
    return xxhash.xxh3_128_digest(shingles)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"].to_pylist()]
        signatures = [signature(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(
                    [_class(s.tobytes()) if len(s) else None for s in sets],
                    pa.binary(),
                ),
                pa.array([None if s is None else s.tobytes() for s in signatures], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "class", "signature"],
        )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(_matrix(batch["signature"])).ravel()
        rows = np.repeat(np.arange(batch.num_rows), BANDS)
        bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(bands), batch["doc_id"].take(pa.array(rows))],
            names=["key", "band", "doc_id"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_class(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())],
            names=["class", "shingles"],
        )


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = _matrix(batch["sig_a"]), _matrix(batch["sig_b"])
        left, _ = _survive(
            lambda rows, i, j: (a[rows, i:j] == b[rows, i:j]).sum(axis=1), batch.num_rows
        )
        yield batch.select(["a", "b"]).take(pa.array(left))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (
            [np.frombuffer(x, dtype=np.uint64) for x in batch[c].to_pylist()]
            for c in ("set_a", "set_b")
        )
        keep = [_similar(x, y) for x, y in zip(a, b)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _across(block: pa.Table) -> pa.Table:
    """Links between different components in two blocks of a bucket, as far as they connect more.

    Promising pairs are confirmed on their sets, the most promising first; pairs that a link
    found here connects are left out.
    """
    ids, of = block["doc_id"].to_numpy(), block["component"].to_numpy()
    second = block["second"].to_numpy()
    signatures = _matrix(block["signature"].combine_chunks())
    sets = [np.frombuffer(x, dtype=np.uint64) for x in block["shingles"].to_pylist()]
    same = bool(block["same"][0].as_py())
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    if same:
        right = left
    i, j = np.nonzero(of[left][:, None] != of[right][None, :])
    i, j = left[i], right[j]
    if same:
        i, j = i[i < j], j[i < j]
    found, matches = _survive(
        lambda rows, x, y: (signatures[i[rows], x:y] == signatures[j[rows], x:y]).sum(axis=1),
        len(i),
    )
    found = found[np.argsort(-matches, kind="stable")]
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := joined.get(c, c)) != c:
            c = up
        return c

    links = []
    for x, y in zip(i[found].tolist(), j[found].tolist()):
        cx, cy = root(of[x]), root(of[y])
        if cx != cy and _similar(sets[x], sets[y]):
            joined[cx] = cy
            links.append(sorted((int(ids[x]), int(ids[y]))))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _with_both(pairs: DataFrame, of: DataFrame, value: str, short: str) -> DataFrame:
    """``pairs`` (a, b) with the value of both."""
    for side in ("a", "b"):
        own = of.select(F.col("doc_id").alias(side), F.col(value).alias(f"{short}_{side}"))
        pairs = pairs.join(own, side)
    return pairs


def _full_sets(documents: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the classes with the given numbers: their first documents' texts are
    shingled again."""
    known = classes.select(F.col("node").alias("doc_id"), "class", "first")
    wanted = stage(known.join(nodes.distinct(), "doc_id", "left_semi"), "wanted")
    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = documents.join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "class binary, shingles binary")
    # rows of one id can have other texts, and equal ones
    sets = sets.join(wanted.select("class", "doc_id"), "class").drop("class")
    sets = stage(sets.dropDuplicates(["doc_id"]), "sets")
    release(wanted)
    return sets


def _confirm(pairs: DataFrame, signatures: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that survive comparing signatures and are similar on their full sets."""
    signed = _with_both(pairs.distinct(), signatures, "signature", "sig")
    pairs = stage(signed.mapInArrow(_promising, "a long, b long"), "survivors")
    sets = _full_sets(documents, classes, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    both = _with_both(pairs, sets, "shingles", "set")
    links = stage(both.mapInArrow(_confirmed, "a long, b long"), "confirmed")
    release(pairs, sets)
    return links


def _component_of(members: DataFrame, nodes: DataFrame, column: str, name: str) -> DataFrame:
    """``members`` with the component of ``column``: the node itself unless it is linked."""
    known = nodes.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = members.join(known, members[column] == known["__node"], "left")
    own = F.coalesce("__component", column).alias(name)
    return joined.select(*[members[c] for c in members.columns], own)


def _cross_links(
    members: DataFrame, nodes: DataFrame, signed: DataFrame, documents: DataFrame, classes: DataFrame
) -> DataFrame:
    """Links between components that meet in a bucket.

    ``members`` (key, doc_id, ...), ``nodes`` (node, component). Members of a large component are
    dealt over blocks of their own, the others over common blocks; a pair of blocks is a task. Of
    buckets with the same members, as every band of a group of near copies has, one is taken.
    """
    known = _component_of(members.select("key", "doc_id"), nodes, "doc_id", "component")
    mixed = known.groupBy("key").agg(
        F.min("component").alias("first"),
        F.max("component").alias("last"),
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    )
    # in a bucket of two, the one pair has been compared
    mixed = mixed.where("first <> last and n > 2").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    open_ = stage(known.join(mixed.select("key"), "key"), "open")
    sizes = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    small = F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)
    totals = sizes.groupBy("key").agg(F.sum(small).alias("small"))
    sizes = sizes.join(totals, "key")
    large = F.col("n") > BLOCK
    shares = F.greatest(F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / BLOCK), F.lit(1))
    mark = F.when(large, F.xxhash64("doc_id")).otherwise(F.xxhash64("component"))
    placed = open_.join(sizes, ["key", "component"]).select(
        "key",
        "doc_id",
        "component",
        F.when(large, F.col("component")).alias("alone"),  # null for the common blocks
        F.pmod(mark, shares.cast("long")).alias("share"),
    )
    block = F.struct("alone", "share")
    placed = stage(placed.withColumn("block", block).drop("alone", "share"), "blocks")
    blocks = placed.select("key", "block").distinct()
    a = blocks.select("key", F.col("block").alias("x"))
    b = blocks.select("key", F.col("block").alias("y"))
    tasks = a.join(b, "key").where("x <= y and not (x.alone <=> y.alone and x.alone is not null)")
    same = F.col("x") == F.col("y")
    tasks = tasks.select("key", "x", "y", same.alias("same"))
    ends = tasks.select("*", F.col("x").alias("block"), F.lit(False).alias("second")).union(
        tasks.where("not same").select("*", F.col("y").alias("block"), F.lit(True).alias("second"))
    )
    sets = _full_sets(documents, classes, placed.select("doc_id"))
    whole = sets.join(signed.select("doc_id", "signature"), "doc_id")
    rows = ends.join(placed, ["key", "block"]).join(whole, "doc_id")
    links = rows.groupBy("key", "x", "y").applyInArrow(_across, "a long, b long")
    links = stage(links, "cross-links")
    release(open_, placed, sets)
    return links


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    ship(spark)
    bound_batches(spark)
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    signed = stage(
        texts.mapInArrow(
            _signed, "doc_id long, n_shingles long, class binary, signature binary"
        ),
        "signatures",
    )
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("class").agg(F.min("doc_id").alias("first"))
    # numbered: an id can stand on rows of several classes. ``doc_id`` is a class's number from here
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    firsts = classes.select("class", F.col("first").alias("doc_id"), "node")
    reps = linkable.join(firsts, ["class", "doc_id"]).select(F.col("node").alias("doc_id"), "signature")
    reps = stage(reps.dropDuplicates(["doc_id"]), "representatives")  # equal rows

    placed = reps.mapInArrow(_banded, "key long, band int, doc_id long")
    shared = placed.groupBy("key").agg(
        F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")
    )
    shared = shared.where("pivot < last").select("key", "pivot")
    members = stage(placed.join(shared, "key"), "members")

    others = members.where("doc_id <> pivot")
    pairs = others.select("band", F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    links = _confirm(pairs.where(F.col("band") < FIRST_BANDS).select("a", "b"), reps, texts, classes)
    # what is linked to the same member is connected; that much is known without iterating
    nodes = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    pairs = pairs.where(F.col("band") >= FIRST_BANDS).select("a", "b").distinct()
    pairs = _component_of(_component_of(pairs, nodes, "a", "of_a"), nodes, "b", "of_b")
    links = links.union(_confirm(pairs.where("of_a <> of_b").select("a", "b"), reps, texts, classes))
    nodes = components(links, "a", "b")
    links = links.union(_cross_links(members, nodes, reps, texts, classes))
    nodes = components(links, "a", "b")

    linked = classes.join(nodes, "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("class", "least")
    known = classes.select("class", "first").join(linked, "class", "left")
    known = stage(known.select("class", F.coalesce("least", "first").alias("component")), "component-ids")
    release(members, reps, classes)
    rows = signed.select("doc_id", "n_shingles", "class").join(known, "class", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )

"""Near-duplicates of embeddings through an inverted multi-index.

The two halves of a unit vector have codebooks of their own; the pairs of their codewords form a
grid of cells. Every vector is posted in the cell of its two nearest codewords. It then visits cells
from near to far, in the order of its distance to their codewords, until the next one is farther
than its own cell by more than a margin. In a visited cell every posted vector is verified by its
cosine in double precision.

The margin is measured, and the largest of these is taken. Pairs at the very cosine of a link must
find each other with probability ``RECALL``, both where they differ in random directions and where
they differ along differences of data vectors, which stay in the data's subspace however low its rank.
So must the true links of at most ``QUERIES`` vectors of each length, found by comparing these with
all rows: the share is taken of all links, and once more with each query counting the same, so that
one large group does not set it alone.

Codebooks are fitted on a bounded sample, at most ``SAMPLE_ROWS`` vectors (least hash of the id), of
which the queries are part; all vectors are indexed and all visit. The grid grows with the table, so
cells stay small in the mean. A cell that holds many vectors all the same is dealt in blocks of
``BLOCK``; pairs of blocks are verified in tasks of their own, which give link counts for each vector
and a spanning forest of the links, never the links themselves. Equal vectors are one class, verified once.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do vectors
of different lengths with each other. Repeated ids are rows of their own. A null id is counted as
any other, and its row is its own component. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import stage
from textprep_spark.llm.components import components
from textprep_spark.shipping import ship

COSINE = 0.95
RECALL = 0.995
SAMPLE_ROWS = 20_000
PER_CELL = 128  # vectors in a cell, in the mean
MOST_WORDS = 1024  # of a codebook
QUERIES = 2000  # vectors of each length whose true links are found
BINS = 4096  # of excess distances
MOST_EXCESS = 8.0
BLOCK = 1024
ROUNDS = 8  # of fitting a codebook
CELL_BITS = 12  # of a codeword's number


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances, each summed in the same order whatever else is in the batch."""
    out = np.empty((len(x), len(words)))
    for i, word in enumerate(words):
        off = x - word
        out[:, i] = (off * off).sum(axis=1)
    return out


def _codebook(x: np.ndarray, n: int, chance: np.random.Generator) -> np.ndarray:
    words = x[chance.permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS):
        near = (-2 * x @ words.T + (words * words).sum(axis=1)).argmin(axis=1)
        held = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[held > 0] = sums[held > 0] / held[held > 0, None]
    return words


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves of unit vectors, and how much farther to visit."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    def _excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much farther each codeword is than the nearest one."""
        half = self.first.shape[1]
        a, b = _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self._excess(x)
        return (a.argmin(axis=1) << CELL_BITS) + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit. Both codebooks are walked from near to far, together."""
        a, b = self._excess(x)
        near_a, near_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.take_along_axis(a, near_a, 1), np.take_along_axis(b, near_b, 1)
        rows, cells = [], []
        outer = np.arange(len(x))
        for i in range(a.shape[1]):
            outer = outer[a[outer, i] <= self.margin]
            if not len(outer):
                break
            inner = outer
            for j in range(b.shape[1]):
                inner = inner[a[inner, i] + b[inner, j] <= self.margin]
                if not len(inner):
                    break
                rows.append(inner)
                cells.append((near_a[inner, i] << CELL_BITS) + near_b[inner, j])
        return np.concatenate(rows), np.concatenate(cells)

    def goes_to(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector visits the cell named beside it."""
        a, b = self._excess(x)
        at = np.arange(len(x))
        return a[at, cells >> CELL_BITS] + b[at, cells & ((1 << CELL_BITS) - 1)] <= self.margin

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The least margin at which one of each pair visits the other."""
        excess = []
        for one, other in ((x, y), (y, x)):
            a, b = self._excess(one)
            cell, at = self.home(other), np.arange(len(one))
            excess.append(a[at, cell >> CELL_BITS] + b[at, cell & ((1 << CELL_BITS) - 1)])
        return np.minimum(*excess)


def fit_index(sample: np.ndarray, rows: int, cosine: float, recall: float) -> Index:
    """An index for ``rows`` vectors, from a sample of unit vectors."""
    chance = np.random.default_rng(10)
    half = sample.shape[1] // 2
    n = min(max(1, round(math.sqrt(rows / PER_CELL))), MOST_WORDS, len(sample))
    first = _codebook(sample[:, :half], n, chance)
    second = _codebook(sample[:, half:], n, chance)
    index = Index(first, second, 0.0)
    x = sample[:4000]
    differences = sample[chance.integers(len(sample), size=len(x))]
    differences = differences - sample[chance.integers(len(sample), size=len(x))]
    margin = 0.0
    for aside in (chance.normal(size=x.shape), differences):
        aside -= (aside * x).sum(axis=1, keepdims=True) * x
        length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
        some = length[:, 0] > 1e-9
        if some.any():
            y = cosine * x[some] + math.sqrt(1 - cosine**2) * aside[some] / length[some]
            apart = index.apart(x[some], y)
            margin = max(margin, float(np.quantile(apart, recall, method="higher")))
    return Index(first, second, margin)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy().astype(np.float64)
    return unit(flat.reshape(len(vectors), -1))


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix ``linked`` connects, one less than each group has."""
    out, open_ = [], linked.any(axis=1)
    seen = np.zeros(linked.shape[1], dtype=bool)
    for start in range(len(left)):
        if not open_[start]:
            continue
        group, front = [], np.array([start])
        while len(front):
            open_[front] = False
            group += left[front].tolist()
            new = linked[front].any(axis=0) & ~seen
            seen |= new
            group += right[new].tolist()
            front = np.flatnonzero(linked[:, new].any(axis=1) & open_)
        least = min(group)
        out += [(least, other) for other in set(group) - {least}]
    return out


def _indexes(sample: list[tuple], rows: dict[int, int], cosine: float, recall: float) -> dict:
    by_length: dict[int, list] = {}
    for (v,) in sample:
        by_length.setdefault(len(v), []).append(v)
    found = {}
    for length, n in rows.items():
        own = by_length.get(length)
        if own is None:  # too rare for the sample: one cell
            none = np.zeros((1, length // 2)), np.zeros((1, length - length // 2))
            found[length] = Index(*none, float("inf"))
        else:
            found[length] = fit_index(unit(np.array(own, dtype=float)), n, cosine, recall)
    return found


def _widened(one: DataFrame, sample: list[tuple], indexes: dict, cosine: float, recall: float) -> dict:
    """``indexes`` with margins at which true links of some of the sample are found as well."""
    queries: dict[int, list] = {}
    for node, v in sample:
        own = queries.setdefault(len(v), [])
        if len(own) < QUERIES and math.isfinite(indexes[len(v)].margin):
            own.append((node, v))
    queries = {
        length: (np.array([n for n, _ in own]), unit(np.array([v for _, v in own], dtype=float)))
        for length, own in queries.items()
        if own
    }
    shared = one.sparkSession.sparkContext.broadcast((queries, indexes))  # part of the sample

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many links of each query lie in each bin of excess."""
        queries, indexes = shared.value
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy()
            for length in np.unique(sizes).tolist():
                if length not in queries:
                    continue
                own = batch.filter(pa.array(sizes == length))
                nodes, index = own["node"].to_numpy(), indexes[length]
                names, q = queries[length]
                for start in range(0, len(nodes), BLOCK):
                    x = _units(own["vector"].slice(start, BLOCK))
                    hits = x @ q.T >= cosine
                    hits &= nodes[start : start + BLOCK, None] != names[None, :]
                    at, which = np.nonzero(hits)
                    found: dict[int, int] = {}
                    for part in range(0, len(at), BLOCK):
                        some = slice(part, part + BLOCK)
                        apart = index.apart(x[at[some]], q[which[some]])
                        bins = np.ceil(apart * (BINS / MOST_EXCESS)).astype(np.int64)
                        for key, n in zip(*np.unique(which[some] * 2 * BINS + bins, return_counts=True)):
                            found[int(key)] = found.get(int(key), 0) + int(n)
                    keys = np.array(list(found), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), length, dtype=np.int32)),
                            pa.array((keys // (2 * BINS)).astype(np.int32)),
                            pa.array((keys % (2 * BINS)).astype(np.int32)),
                            pa.array(list(found.values()), pa.int64()),
                        ],
                        names=["length", "query", "bin", "n"],
                    )

    links = one.select("node", "vector").mapInArrow(linked, "length int, query int, bin int, n long")
    links = links.groupBy("length", "query", "bin").agg(F.sum("n").alias("n"))
    links = links.groupBy("length", "query").agg(
        F.collect_list(F.struct("bin", "n")).alias("bins"), F.sum("n").alias("total")
    )
    links = links.select("length", "total", F.inline("bins"))
    links = links.groupBy("length", "bin").agg(
        F.sum("n").alias("links"), F.sum(F.col("n") / F.col("total")).alias("queries")
    )
    wider = dict(indexes)
    by_length: dict[int, list] = {}
    for r in links.collect():  # at most 2 * BINS rows of each length
        by_length.setdefault(r.length, []).append((r.bin, float(r.links), r.queries))
    for length, rows in by_length.items():
        bins, *weights = (np.array(c) for c in zip(*sorted(rows)))
        for weight in weights:
            reached = np.cumsum(weight) >= recall * weight.sum() * (1 - 1e-12)
            margin = float(bins[reached.argmax()]) * (MOST_EXCESS / BINS)
            own = wider[length]
            wider[length] = Index(own.first, own.second, max(own.margin, margin))
    return wider


def near_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    ship(spark)
    kind = embeddings.schema["embedding"].dataType.simpleString()
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    rows = rows.select(
        "*",
        _usable(F.col("vector")).alias("usable"),
        F.xxhash64("vector").alias("h1"),
        F.xxhash64("vector", F.lit(1)).alias("h2"),
    )
    marked = stage(rows, "vectors")
    usable = marked.where("usable")
    classes = usable.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    classes = stage(classes.withColumn("node", F.coalesce("first", "h1")), "vector-classes")
    one = usable.select("h1", "h2", "vec_id", "vector").join(classes, ["h1", "h2"])
    one = one.where(F.col("vec_id").eqNullSafe(F.col("first")))
    one = one.dropDuplicates(["h1", "h2"]).select("node", "copies", "vector")
    one = stage(one, "vector-representatives")

    sample = one.select("node", "vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS)
    lengths = one.groupBy(F.size("vector").alias("length")).count().collect()
    sample = sample.collect()
    rows = {r.length: r["count"] for r in lengths}
    indexes = _indexes([(v,) for _, v in sample], rows, cosine, recall)
    indexes = _widened(one, sample, indexes, cosine, recall)
    shared = spark.sparkContext.broadcast(indexes)  # two codebooks of at most MOST_WORDS words

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector once for each cell that it visits; ``home`` is where it is posted."""
        for batch in batches:
            sizes = batch["vector"].value_lengths().to_numpy()
            for length in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == length))
                index, x = shared.value[length], _units(own["vector"])
                at, cells = index.visits(x)
                home = index.home(x)
                out = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        out["node"],
                        out["copies"],
                        out["vector"],
                        pa.array(np.full(len(at), length, dtype=np.int32)),
                        pa.array(home[at]),
                        pa.array(cells),
                    ],
                    names=["node", "copies", "vector", "length", "home", "cell"],
                )

    visits = one.mapInArrow(
        placed,
        f"node long, copies long, vector {kind}, length int, home long, cell long",
    )
    visits = stage(visits, "visits")
    at_home = F.col("home") == F.col("cell")
    sizes = visits.groupBy("length", "cell").agg(
        F.ceil(F.count(F.when(at_home, 1)) / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("guests"),
    )
    visits = visits.join(sizes.where("blocks > 0"), ["length", "cell"])
    mark = F.xxhash64("node")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.sequence(F.lit(0), F.col("guests") - 1)
    guest_block = F.pmod(mark, F.col("guests")).cast("int")
    host_block = F.pmod(mark, F.col("blocks")).cast("int")
    columns = ["node", "copies", "vector", "length", "home", "cell"]
    guests = visits.select(
        *columns, F.lit(False).alias("host"), F.explode(every).alias("x"), guest_block.alias("y")
    )
    hosts = visits.where("home = cell").select(
        *columns, F.lit(True).alias("host"), host_block.alias("x"), F.explode(others).alias("y")
    )

    def verified(block: pa.Table) -> pa.Table:
        """Link counts (node, null, n) and links of a spanning forest (node, other, 0)."""
        host = block["host"].to_numpy()
        node, copies = block["node"].to_numpy(), block["copies"].to_numpy()
        home, cell = block["home"].to_numpy(), block["cell"][0].as_py()
        x = _units(block["vector"].combine_chunks())
        guests, hosts = np.flatnonzero(~host), np.flatnonzero(host)
        linked = x[guests] @ x[hosts].T >= cosine
        linked &= node[guests][:, None] != node[hosts][None, :]
        g, h = np.nonzero(linked)
        counts = np.bincount(guests[g], weights=copies[hosts[h]], minlength=len(node))
        # a guest's own cell may be one that its host does not visit: then count for both here
        away = home[guests[g]] != cell
        g, h = guests[g[away]], hosts[h[away]]
        index = shared.value[block["length"][0].as_py()]
        alone = ~index.goes_to(x[h], home[g])
        counts += np.bincount(h[alone], weights=copies[g[alone]], minlength=len(node))
        some = np.flatnonzero(counts)
        links = _forest(linked, node[guests], node[hosts])
        a, b = zip(*links) if links else ((), ())
        return pa.table(
            {
                "node": pa.array([*node[some].tolist(), *a], pa.int64()),
                "other": pa.array([None] * len(some) + list(b), pa.int64()),
                "n": pa.array([*counts[some].astype(np.int64).tolist(), *[0] * len(a)], pa.int64()),
            }
        )

    found = (
        guests.union(hosts)
        .groupBy("length", "cell", "x", "y")
        .applyInArrow(verified, "node long, other long, n long")
    )
    found = stage(found, "vector-links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("linked"))
    nodes = components(found.where("other is not null"), "node", "other")

    known = marked.select("vec_id", "h1", "h2", "usable").join(
        classes.withColumn("usable", F.lit(True)), ["h1", "h2", "usable"], "left"
    )
    known = known.join(counts, "node", "left")
    known = known.join(nodes.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    linked = F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.coalesce("component", "first", "vec_id")
    return known.select(
        "vec_id",
        linked.cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )

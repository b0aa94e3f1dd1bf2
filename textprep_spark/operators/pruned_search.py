"""Exact top-k vector search that leaves out whole cells of documents.

Documents are dealt to the nearest of a bounded number of pivots, which are documents themselves. A cell
is a ball: its pivot and the largest distance in it. A query first meets the documents of its own cell;
its ``k``-th best score there is a bound. By the triangle inequality no document of another cell is nearer
than the distance to its pivot less the cell's radius. Cells in which even that would not reach the bound
are skipped; in the others every document is compared. So the result is that of ``search.top_k``, ties
included.

The inequality holds for distances that are metrics: euclidean (squares follow from it), cityblock,
chebyshev and canberra as they are, cosine by the angle, correlation by the angle of centred vectors. Bray
and Curtis' measure is none; ask ``search.top_k`` for it.

Cells of any size are dealt over blocks by a hash of the id, and so are the queries that visit them; a task
gets a block of each. The driver learns the pivots and one radius and count a cell. Vectors without a
direction, whose cosine is undefined, have a cell of their own, which queries visit that find fewer than
``k`` others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textprep_spark.operators.search import (
    BLOCK_BYTES,
    DISTANCES,
    _best_documents,
    _block,
    _ids,
    _matrix,
    _ranked,
    _result_schema,
    _vector_rows,
    top_k,
)
from textprep_spark.shipping import ship
from textprep_spark.sources.writers import stage

CELLS = 256  # pivots
SLACK = 1e-6  # of a bound on a distance, against rounding

_ANGLES = ("cosine", "correlation")
_MEASURED_BY = {"sqeuclidean": "euclidean"} | {m: m for m in ("euclidean", "cityblock", "chebyshev", "canberra")}


def _angles(distance: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    return lambda a, b: np.arccos(np.clip(1.0 - distance(a, b), -1.0, 1.0))


def _measure(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The true metric by which a search's distance is bounded."""
    if metric in _ANGLES:
        return _angles(DISTANCES[metric])
    if metric not in _MEASURED_BY:
        raise ValueError(f"no triangle inequality for {metric!r}; known: {sorted([*_ANGLES, *_MEASURED_BY])}")
    return DISTANCES[_MEASURED_BY[metric]]


def _best_score(metric: str, distance: Column) -> Column:
    """The score of a document at the given true distance."""
    if metric in _ANGLES:
        return F.cos(F.least(distance, F.lit(np.pi)))
    return 1 - (distance * distance if metric == "sqeuclidean" else distance)


@dataclass(frozen=True)
class Searched:
    """``hits`` (query_id, doc_id, score, rank), and ``visits`` (query_id, visited, cells): how many of
    the cells each query met."""

    hits: DataFrame
    visits: DataFrame


def _placed(vectors: DataFrame, id_column: str, pivots: np.ndarray, metric: str, all_distances: bool) -> DataFrame:
    """Adds ``cell``, the nearest pivot (their number for vectors without any), and ``distance``: from
    it, or, as an array, from every pivot."""
    measure, none = _measure(metric), len(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = measure(_matrix(batch["embedding"]), pivots)
            lost = np.isnan(d).any(axis=1)
            d[lost] = 0.0
            cell = np.where(lost, none, d.argmin(axis=1)).astype(np.int32)
            near = pa.array(list(d)) if all_distances else pa.array(d.min(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch[id_column], batch["embedding"], pa.array(cell), near], names=[id_column, "embedding", "cell", "distance"]
            )

    kind = "array<double>" if all_distances else "double"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(place, f"{schema}, cell int, distance {kind}")


def _compared(queries: DataFrame, corpus: DataFrame, k: int, metric: str, blocks: Column, rows: int) -> DataFrame:
    """Best documents of each query (query_id, embedding, cell) in the cell it visits."""
    schema = _result_schema(queries, corpus)
    none = to_arrow_schema(schema).empty_table()
    visitors = queries.groupBy("cell").agg(F.count("*").alias("visitors"))
    shares = F.ceil(F.col("visitors") / rows).cast("int")
    known = queries.join(visitors, "cell")  # counts of a bounded number of cells
    left = known.select(
        "query_id", "embedding", "cell", F.pmod(F.xxhash64("query_id"), shares).alias("q"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("c"),
    )
    right = corpus.join(visitors, "cell").select(
        "doc_id", "embedding", "cell", F.explode(F.sequence(F.lit(0).cast("long"), (shares - 1).cast("long"))).alias("q"),
        F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("c"),
    )

    def task(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        query_ids, q = _block(ours, "query_id")
        doc_ids, c = _block(theirs, "doc_id")
        if q is None or c is None:
            return none
        return pa.Table.from_batches([_best_documents(q, _ids(doc_ids), c, k, metric).rows(query_ids)])

    key = ["cell", "q", "c"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(task, schema)


def pruned_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    cells: int = CELLS,
    block_bytes: int = BLOCK_BYTES,
) -> Searched:
    """The ``k`` best documents of every query, exactly, as ``search.top_k`` finds them.

    ``queries(query_id, embedding)``, ``corpus(doc_id, embedding)``; ids are unique. ``cells`` bounds the
    number of pivots.
    """
    if k < 1 or cells < 1:
        raise ValueError("k and cells must be at least 1")
    _measure(metric)
    spark = queries.sparkSession
    ship(spark)
    corpus, _ = stage(_vector_rows(corpus, "doc_id"), "corpus-vectors")
    first = corpus.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cells).select("embedding").toArrow()
    if not len(first):
        none = F.lit(0).alias("visited"), F.lit(0).alias("cells")
        return Searched(top_k(queries, corpus, k, metric), queries.select("query_id", *none))
    pivots = _matrix(pa.concat_arrays(first["embedding"].chunks))
    usable = ~np.isnan(_measure(metric)(pivots, pivots).diagonal())
    pivots = pivots[usable] if usable.any() else pivots[:1]
    corpus, _ = stage(_placed(corpus, "doc_id", pivots, metric, False), "placed-documents")
    stats = corpus.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()  # cells
    width = 8 * pivots.shape[1]
    rows = max(1, block_bytes // width)
    blocks, radius = [1] * (len(pivots) + 1), [-1.0] * (len(pivots) + 1)  # -1: an empty cell
    for row in stats:
        blocks[row["cell"]], radius[row["cell"]] = -(-row["n"] // rows), row["radius"]

    def of_cell(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("cell"))

    queries, _ = stage(_placed(_vector_rows(queries, "query_id"), "query_id", pivots, metric, True), "placed-queries")
    own = queries.select("query_id", "embedding", "cell")
    home, _ = stage(_compared(own, corpus, k, metric, of_cell(blocks), rows), "home-hits")
    bounds = _ranked(home, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    asking = queries.join(bounds, "query_id", "left")
    radii = F.array(*map(F.lit, radius))

    def reaches(c: Column) -> Column:
        nearest = F.greatest(F.get("distance", c) - F.get(radii, c) - SLACK, F.lit(0.0))
        lost = c == len(pivots)
        possible = F.when(lost, F.lit(False)).otherwise(_best_score(metric, nearest) >= F.col("bound") - 2e-9)
        return (c != F.col("cell")) & (F.get(radii, c) >= 0) & (F.col("bound").isNull() | possible)

    others = F.filter(F.sequence(F.lit(0), F.lit(len(pivots))), reaches)
    asking, _ = stage(asking.select("query_id", "embedding", others.alias("others")), "open-queries")
    visiting = asking.select("query_id", "embedding", F.explode("others").alias("cell"))
    rest = _compared(visiting, corpus, k, metric, of_cell(blocks), rows)
    visits = asking.select("query_id", (F.size("others") + 1).alias("visited"), F.lit(len(stats)).alias("cells"))
    return Searched(_ranked(home.union(rest), k), visits)

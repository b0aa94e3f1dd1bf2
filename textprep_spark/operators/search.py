"""Exact top-k vector search and first-k keyword search.

Both sides are dealt into blocks by a hash of their ids, and every block of queries meets every
block of documents in one task, which returns the ``k`` best per query only. Ranking takes two
stages: first among a group of blocks, then over all. Each input plan runs exactly once, whatever
the number of blocks: vectors, which may come out of a model, are staged, and block counts come
from the staged tables. Neither side passes the driver.

A caller who knows that one side is small may say so: ``held="queries"`` or ``held="corpus"``
broadcasts that side and streams the other past it without a shuffle.

No query-document pair is ever a row; no candidate is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textprep_spark.functions.text import keyword_tokens
from textprep_spark.shipping import ship
from textprep_spark.sources.writers import stage

BLOCK_BYTES = 32 * 1024 * 1024  # of vectors of one side in a task
TOKEN_BLOCK = 50_000  # distinct tokens in a task
SCORE_DIGITS = 9  # scores are compared after rounding, so that summation order cannot decide ranks

_CELLS = 4_000_000  # scores held at once per worker: bounds memory whatever the batch size


# --- distances: block of queries x block of documents -> matrix ---------------------------


def _pairwise(one_query: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def matrix(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.stack([one_query(row, c) for row in q]) if len(q) else np.empty((0, len(c)))

    return matrix


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        unit_q = q / np.linalg.norm(q, axis=1, keepdims=True)
        unit_c = c / np.linalg.norm(c, axis=1, keepdims=True)
        return 1.0 - unit_q @ unit_c.T


def _correlation(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _cosine(q - q.mean(axis=1, keepdims=True), c - c.mean(axis=1, keepdims=True))


def _safe_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0)


DISTANCES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": _cosine,
    "correlation": _correlation,
    "euclidean": _pairwise(lambda q, c: np.sqrt(((c - q) ** 2).sum(axis=1))),
    "sqeuclidean": _pairwise(lambda q, c: ((c - q) ** 2).sum(axis=1)),
    "cityblock": _pairwise(lambda q, c: np.abs(c - q).sum(axis=1)),
    "chebyshev": _pairwise(lambda q, c: np.abs(c - q).max(axis=1)),
    "canberra": _pairwise(
        lambda q, c: _safe_ratio(np.abs(c - q), np.abs(c) + np.abs(q)).sum(axis=1)
    ),
    "braycurtis": _pairwise(
        lambda q, c: _safe_ratio(np.abs(c - q).sum(axis=1), np.abs(c + q).sum(axis=1))
    ),
}


def _scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Rounded similarity ``1 - distance``; undefined ones become -inf so that they rank last."""
    s = np.round(1.0 - DISTANCES[metric](q, c), SCORE_DIGITS)
    return np.where(np.isnan(s), -np.inf, s + 0.0)


# --- k best of a batch ------------------------------------------------------------------------


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Arrow list column -> matrix, without touching single rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors differ in length: {sorted(lengths)}")
    return flat.reshape(len(vectors), -1)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest scores of each row, ascending; among equal ones the first."""
    n, m = scores.shape
    if m <= k:
        return np.broadcast_to(np.arange(m), (n, m))
    cut = np.partition(scores, m - k, axis=1)[:, m - k, None]
    above, equal = scores > cut, scores == cut
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal & (np.cumsum(equal, axis=1) <= room))[1].reshape(n, k)


class _Best:
    """The ``k`` best documents of each query seen so far: by score, then by smaller id."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.n, self.k = n_queries, k
        self.scores = np.empty((n_queries, 0))
        self.ids: np.ndarray | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores of documents whose ``ids`` ascend, all queries at once."""
        near = _best_of(scores, self.k)
        both = np.concatenate([self.scores, np.take_along_axis(scores, near, 1)], axis=1)
        known = ids[near] if self.ids is None else np.concatenate([self.ids, ids[near]], axis=1)
        by_id = np.argsort(known, axis=1, kind="stable")
        both, known = np.take_along_axis(both, by_id, 1), np.take_along_axis(known, by_id, 1)
        order = np.argsort(-both, axis=1, kind="stable")[:, : self.k]
        self.scores = np.take_along_axis(both, order, 1)
        self.ids = np.take_along_axis(known, order, 1)

    def rows(self, query_ids: pa.Array, **more) -> pa.RecordBatch:
        kept = self.scores.shape[1]
        return _rows(query_ids, kept, self.ids.ravel(), self.scores.ravel(), **more)


def _rows(query_ids: pa.Array, counts, doc_ids: np.ndarray, scores: np.ndarray, **more):
    known = ~np.isneginf(scores)
    columns = {
        "query_id": query_ids.take(pa.array(np.repeat(np.arange(len(query_ids)), counts))),
        "doc_id": pa.array(doc_ids),
        "score": pa.array(scores, mask=~known),
    }
    columns.update({name: pa.array(values) for name, values in more.items()})
    return pa.RecordBatch.from_pydict(columns)


def _slices(n_rows: int, n_columns: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, n_columns))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def _result_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("doc_id", corpus.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _block(rows: pa.Table, id_column: str) -> tuple[pa.Array, np.ndarray] | tuple[None, None]:
    """``(ids, matrix)`` of a block of vectors, ids ascending."""
    if not len(rows):
        return None, None
    rows = rows.sort_by(id_column)
    ids, vectors = (pa.concat_arrays(rows[c].chunks) for c in (id_column, "embedding"))
    return ids, _matrix(vectors)


def _best_documents(q: np.ndarray, documents: np.ndarray, c: np.ndarray, k: int, metric: str) -> _Best:
    best = _Best(len(q), k)
    for part in _slices(len(documents), len(q)):
        best.add(_scores(q, c[part], metric), documents[part])
    return best


def _stream_corpus(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    """Best documents per task, the queries broadcast; the caller ranks over all tasks."""
    held = corpus.sparkSession.sparkContext.broadcast(_block(queries.toArrow(), "query_id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = held.value
        best = _Best(0 if q is None else len(q), k)
        for batch in batches:
            if q is None or not batch.num_rows:
                continue
            batch = batch.sort_by("doc_id")
            docs, c = _ids(batch["doc_id"]), _matrix(batch["embedding"])
            for part in _slices(len(docs), len(q)):
                best.add(_scores(q, c[part], metric), docs[part])
        if best.ids is not None:
            yield best.rows(query_ids)

    return corpus.mapInArrow(task, _result_schema(queries, corpus))


def _stream_queries(queries: DataFrame, corpus: DataFrame, k: int, metric: str) -> DataFrame:
    """Complete, ranked results, the corpus broadcast: every query meets it within its batch."""
    held = queries.sparkSession.sparkContext.broadcast(_block(corpus.toArrow(), "doc_id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, c = held.value
        if c is None:
            return
        docs = _ids(doc_ids)
        for batch in batches:
            q = _matrix(batch["embedding"])
            for part in _slices(len(q), len(c)):
                best = _Best(part.stop - part.start, k)
                best.add(_scores(q[part], c, metric), docs)
                rank = np.arange(1, best.scores.shape[1] + 1, dtype=np.int32)
                ids = batch["query_id"].slice(part.start, part.stop - part.start)
                yield best.rows(ids, rank=np.tile(rank, len(ids)))

    schema = _result_schema(queries, corpus).add("rank", T.IntegerType())
    return queries.mapInArrow(task, schema)


def _vector_rows(df: DataFrame, id_column: str) -> DataFrame:
    """Ids and vectors. A null vector is an error, not a row to leave out."""
    element = df.schema["embedding"].dataType.elementType
    vector = F.col("embedding")
    if not isinstance(element, (T.FloatType, T.DoubleType)):
        vector = vector.cast("array<double>")
    missing = F.concat(F.lit(f"no vector for {id_column} "), F.col(id_column).cast("string"))
    failed = F.raise_error(F.coalesce(missing, F.lit("no vector"))).cast(
        "array<double>" if not isinstance(element, T.FloatType) else "array<float>"
    )
    return df.select(id_column, F.coalesce(vector, failed).alias("embedding"))


def _blocks_of(vectors: DataFrame, block_bytes: int) -> int:
    """Into how many blocks a staged table goes; counted from the table, not from its plan."""
    row = vectors.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)).alias("n")).first()
    return max(1, math.ceil(8 * row["n"] / block_bytes))


def _ranked(candidates: DataFrame, k: int, *within: str) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.col("doc_id")]
    w = Window.partitionBy("query_id", *within).orderBy(*order)
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _own_block(id_column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(blocks)).cast("int")


def _every_block(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _block_pairs(
    queries: DataFrame, corpus: DataFrame, k: int, metric: str, block_bytes: int
) -> DataFrame:
    """Best documents of every pair of blocks, then the best of groups of blocks."""
    queries, _ = stage(queries, "query-vectors")
    corpus, _ = stage(corpus, "corpus-vectors")
    n, m = _blocks_of(queries, block_bytes), _blocks_of(corpus, block_bytes)
    group_size = max(1, math.isqrt(m))
    left = queries.select("*", _own_block("query_id", n).alias("q"), _every_block(m).alias("c"))
    right = corpus.select("*", _every_block(n).alias("q"), _own_block("doc_id", m).alias("c"))

    def task(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        query_ids, q = _block(ours, "query_id")
        doc_ids, c = _block(theirs, "doc_id")
        if q is None or c is None:
            return none
        best = _best_documents(q, _ids(doc_ids), c, k, metric)
        group = np.full(best.scores.size, ours["c"][0].as_py() // group_size, dtype=np.int32)
        return pa.Table.from_batches([best.rows(query_ids, group=group)])

    schema = _result_schema(queries, corpus).add("group", T.IntegerType())
    none = to_arrow_schema(schema).empty_table()
    pairs = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(task, schema)
    return _ranked(pairs, k, "group").drop("rank", "group")


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "cosine",
    held: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the ``k`` best documents of every query, exactly.

    ``queries(query_id, embedding)``, ``corpus(doc_id, embedding)``; ids are unique. The score is
    ``1 - distance``; equal scores rank by smaller id; undefined ones (a zero vector under cosine)
    are null and rank last. Null vectors raise. ``held`` names a side that the caller knows to fit
    the driver and every worker.
    """
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric!r}; known: {sorted(DISTANCES)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if held not in (None, "queries", "corpus"):
        raise ValueError("held must be 'queries', 'corpus' or None")
    ship(queries.sparkSession)
    queries, corpus = _vector_rows(queries, "query_id"), _vector_rows(corpus, "doc_id")
    if held == "corpus":
        return _stream_queries(queries, corpus, k, metric)
    if held == "queries":
        return _ranked(_stream_corpus(queries, corpus, k, metric), k)
    return _ranked(_block_pairs(queries, corpus, k, metric, block_bytes), k)


# --- keyword search --------------------------------------------------------------------------


def _first_ids(tokens_of: dict[str, list[int]], n: int, k: int, batches) -> list[list]:
    """Per query the first ``k`` ids, ascending, of documents that hold one of its tokens.

    ``batches`` give (ids, texts). Every distinct token is looked for once per document, however
    many queries share it, by one automaton.
    """
    hits: list[list] = [[] for _ in range(n)]
    find = ahocorasick.Automaton()
    for token, asking in tokens_of.items():
        find.add_word(token, asking)
    if not tokens_of:
        return hits
    find.make_automaton()
    for ids, texts in batches:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        waiting = {i for asking in tokens_of.values() for i in asking}
        for at in order:
            doc, low = ids[at], texts[at]
            # ids ascend: a query that is full below this one is done with the batch
            found: set[int] = set()
            for _, asking in find.iter(low):
                found.update(asking)
            for i in found & waiting:
                own = hits[i]
                if len(own) == k and doc >= own[-1]:
                    waiting.discard(i)
                elif doc not in own:
                    hits[i] = sorted([*own, doc])[:k]
            if not waiting:
                break
    return hits


def keyword_first(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    held: bool = False,
    token_block: int = TOKEN_BLOCK,
) -> DataFrame:
    """``(query_id, doc_id, rank)``: the first ``k`` documents, by id, that contain any token of
    the query's text as a substring, both lower-cased.

    ``queries(query_id, text)``, ``corpus(doc_id, text)``. ``held`` says that the queries are known
    to fit the driver and every worker: then they are broadcast and the corpus is not shuffled.
    Otherwise blocks of tokens meet blocks of documents, as many as the session's shuffles have
    partitions.
    """
    ship(queries.sparkSession)
    words = F.explode(F.array_distinct(keyword_tokens(F.col("text"))))
    tokens = queries.select("query_id", words.alias("token"))
    low = F.lower("text").alias("text")
    corpus = corpus.where(F.col("text").isNotNull()).select("doc_id", low)
    schema = T.StructType([queries.schema["query_id"], corpus.schema["doc_id"]])
    found = (
        _stream_texts(tokens, corpus, k, schema)
        if held
        else _text_blocks(tokens, corpus, k, schema, token_block)
    )
    w = Window.partitionBy("query_id").orderBy("doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(tokens: pa.Table) -> tuple[list, dict[str, list[int]]]:
    """The query ids, and for each token the numbers of the queries that ask for it."""
    numbers: dict = {}
    asking: dict[str, list[int]] = {}
    for q, token in zip(tokens["query_id"].to_pylist(), tokens["token"].to_pylist()):
        asking.setdefault(token, []).append(numbers.setdefault(q, len(numbers)))
    return list(numbers), asking


def _found(schema: pa.Schema, query_ids: list, hits: list[list]) -> pa.Table:
    pairs = [(q, d) for q, found in zip(query_ids, hits) for d in found]
    columns = [[p[i] for p in pairs] for i in (0, 1)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _stream_texts(tokens: DataFrame, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(_asked(tokens.toArrow()))
    arrow = to_arrow_schema(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, asking = shared.value
        pairs = ((b["doc_id"].to_pylist(), b["text"].to_pylist()) for b in batches)
        hits = _first_ids(asking, len(query_ids), k, pairs)
        yield from _found(arrow, query_ids, hits).to_batches()

    return corpus.mapInArrow(task, schema)


def _text_blocks(
    tokens: DataFrame, corpus: DataFrame, k: int, schema: T.StructType, token_block: int
) -> DataFrame:
    tokens, _ = stage(tokens, "query-tokens")
    distinct = tokens.select(F.count_distinct("token")).first()[0]
    n = max(1, math.ceil(distinct / token_block))
    m = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = tokens.select("*", _own_block("token", n).alias("t"), _every_block(m).alias("c"))
    right = corpus.select("*", _every_block(n).alias("t"), _own_block("doc_id", m).alias("c"))
    arrow = to_arrow_schema(schema)

    def task(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        query_ids, asking = _asked(ours)
        texts = [(theirs["doc_id"].to_pylist(), theirs["text"].to_pylist())]
        return _found(arrow, query_ids, _first_ids(asking, len(query_ids), k, texts))

    pairs = left.groupBy("t", "c").cogroup(right.groupBy("t", "c")).applyInArrow(task, schema)
    return pairs.distinct()  # a query's tokens may stand in several blocks

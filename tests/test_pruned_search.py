"""The pruned search against the search that compares everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprep_spark.operators.pruned_search import pruned_top_k
from textprep_spark.operators.search import top_k

METRICS = ["cosine", "correlation", "euclidean", "sqeuclidean", "cityblock", "chebyshev", "canberra"]


@pytest.fixture(scope="module")
def frames(spark):
    chance = np.random.default_rng(8)
    centres = 20 * chance.normal(size=(12, 8))
    corpus = [c + 0.3 * chance.normal(size=8) for c in centres for _ in range(40)]
    corpus += [corpus[0]] * 150 + [np.zeros(8)] * 2  # a third are equal
    queries = [c + 0.3 * chance.normal(size=8) for c in centres for _ in range(3)] + [corpus[0], np.zeros(8), chance.normal(size=8)]

    def frame(rows, name):
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} int, embedding array<double>")

    return frame(queries, "query_id").repartition(3), frame(corpus, "doc_id").repartition(4)


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("metric", METRICS)
def test_same_result_and_cells_skipped(frames, metric):
    found = pruned_top_k(*frames, 5, metric, cells=24, block_bytes=64 * 60)
    assert rows(found.hits) == rows(top_k(*frames, 5, metric))
    visits = found.visits.agg(F.sum("visited").alias("v"), F.sum("cells").alias("c")).first()
    assert visits.v < (0.9 if metric in ("correlation", "canberra") else 0.5) * visits.c


@pytest.mark.parametrize("k, cells", [(1, 1), (400, 7), (2000, 3)])
def test_any_k(frames, k, cells):
    assert rows(pruned_top_k(*frames, k, "euclidean", cells).hits) == rows(top_k(*frames, k, "euclidean"))


def test_few_and_odd(spark, frames):
    queries, corpus = frames
    assert pruned_top_k(queries, corpus.limit(0)).hits.collect() == []
    assert pruned_top_k(queries.limit(0), corpus).hits.collect() == []
    zeros = corpus.where("embedding[0] = 0")
    assert rows(pruned_top_k(queries, zeros, 3).hits) == rows(top_k(queries, zeros, 3))
    with pytest.raises(ValueError):
        pruned_top_k(queries, corpus, 5, "braycurtis")

"""Retrieval quality as joins and aggregates.

Results have ``(query_id, doc_id, rank)`` rows, labels ``(query_id, doc_id)``; extra grouping
columns such as ``model`` go through unchanged. Averages are null when there is no query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_ranks(results: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every labelled query with the ``rank`` its document got, null when not among the results.

    Queries without a label are left out.
    """
    keys = [*by, "query_id", "doc_id"]
    return labels.where(F.col("doc_id").isNotNull()).join(
        results.select(*keys, "rank"), keys, "left"
    )


def accuracy(rank: str = "rank") -> Column:
    """Share of labelled queries whose document was found."""
    return F.avg(F.col(rank).isNotNull().cast("double"))


def mean_reciprocal_rank(rank: str = "rank") -> Column:
    """Mean of ``1 / rank``, counting 0 for a document that was not found."""
    return F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0)))


def evaluate(
    results: DataFrame, labels: DataFrame, k: int = 5, by: Sequence[str] = ()
) -> DataFrame:
    """``(acc_at_k, mrr_at_k, labelled)``, one row, or one per value of ``by``.

    ``by`` columns are in the labels too, so that a group without any hit still counts.
    """
    ranks = label_ranks(results.where(F.col("rank") <= k), labels, by)
    measures = [
        accuracy().alias("acc_at_k"),
        mean_reciprocal_rank().alias("mrr_at_k"),
        F.count(F.lit(1)).alias("labelled"),
    ]
    return ranks.groupBy(*by).agg(*measures) if by else ranks.agg(*measures)


def first_listed_mrr(
    results: DataFrame, listed: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Mean reciprocal rank of the first *listed* related document that was found.

    ``listed(query_id, related_documents array)``: the list order decides which document counts,
    not the best rank, and only the first ``size(related_documents)`` results are looked at. A
    query without related documents, or with none found, counts 0.
    """
    keys = [*by, "query_id"]
    wanted = listed.select(
        *keys,
        F.size("related_documents").alias("depth"),
        F.posexplode_outer("related_documents").alias("pos", "doc_id"),
    )
    seen = wanted.join(results.select(*keys, "doc_id", "rank"), [*keys, "doc_id"], "left")
    found = F.col("rank").isNotNull() & (F.col("rank") <= F.col("depth"))
    per_query = seen.groupBy(*keys).agg(
        F.min_by(F.col("rank"), F.when(found, F.col("pos"))).alias("rank")
    )
    measures = [mean_reciprocal_rank().alias("mrr"), F.count(F.lit(1)).alias("queries")]
    return per_query.groupBy(*by).agg(*measures) if by else per_query.agg(*measures)


def predictions(results: DataFrame, labels: DataFrame) -> DataFrame:
    """``(query_id, doc_id, top_ids)``: each labelled query's label and ranked result ids."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    lists = results.groupBy("query_id").agg(
        F.transform(ranked, lambda r: r["doc_id"].cast("string")).alias("top_ids")
    )
    return (
        labels.where(F.col("doc_id").isNotNull())
        .join(lists, "query_id", "left")
        .select(
            "query_id",
            "doc_id",
            F.coalesce("top_ids", F.array().cast("array<string>")).alias("top_ids"),
        )
    )


def best_answers(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Every query with its best document and score; both null when there is no result."""
    best = results.where(F.col("rank") == 1).select("query_id", "doc_id", "score")
    return queries.select("query_id").join(best, "query_id", "left")

"""Search evaluation: embed, search, score.

    spark-submit --py-files textprep_spark.zip textprep_spark/plans/evaluate.py \\
        --labels <csv> --records <parquet> --output-dir <dir> \\
        --loader <module>:<function> --model <name> [--language en] [--k 5]
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions.documents import plain_record_text
from textprep_spark.operators.infer import BATCH_SIZE, Loader, embed_texts
from textprep_spark.operators.metrics import (
    accuracy,
    first_listed_mrr,
    label_ranks,
    mean_reciprocal_rank,
    predictions,
)
from textprep_spark.operators.search import keyword_first, top_k
from textprep_spark.sources.readers import read_label_queries, read_table, union_by_name
from textprep_spark.sources.writers import stage, write_predictions


@dataclass(frozen=True)
class Evaluation:
    """``metrics``: one row; ``predictions``: label and top ids per query."""

    metrics: DataFrame
    predictions: DataFrame


def embedded(df: DataFrame, text: str, load: Loader, batch_size: int = BATCH_SIZE) -> DataFrame:
    return embed_texts(df, text, load, "embedding", batch_size).drop(text)


def search(
    queries: DataFrame,
    corpus: DataFrame,
    load: Loader,
    k: int = 5,
    metric: str = "cosine",
    held: str | None = None,
) -> DataFrame:
    """``(query_id, doc_id, score, rank)`` from texts: ``queries(query_id, text)``,
    ``corpus(doc_id, text)``. Either side goes through the model once."""
    asked = queries.where(F.col("text").isNotNull()).select("query_id", "text")
    found = corpus.where(F.col("text").isNotNull()).select("doc_id", "text")
    return top_k(embedded(asked, "text", load), embedded(found, "text", load), k, metric, held)


def evaluate_search(
    queries: DataFrame,
    records: DataFrame,
    load: Loader,
    k: int = 5,
    vector_query: str = "query",
    keyword_query: str = "query_fr",
    metric: str = "cosine",
) -> Evaluation:
    """Accuracy and reciprocal rank of vector search, and accuracy of keyword search.

    ``queries(query_id, <vector_query>, <keyword_query>, doc_id)``, ``records(doc_id, text)``.
    Queries without a label are left out. The two searches may read different query texts. The
    hits of both are staged, so metrics and predictions are of the same search, and no text goes
    through the model again when they are read.
    """
    labelled = queries.where(F.col("doc_id").isNotNull())
    labels = labelled.select("query_id", "doc_id")
    wanted = labelled.select("query_id", F.col(vector_query).alias("text"))
    corpus = records.select("doc_id", "text")
    hits, _ = stage(search(wanted, corpus, load, k, metric), "hits")
    asked = labelled.select("query_id", F.col(keyword_query).alias("text"))
    by_keyword, _ = stage(keyword_first(asked, corpus, k), "keyword-hits")
    ranks = label_ranks(hits, labels).join(
        label_ranks(by_keyword, labels).select("query_id", F.col("rank").alias("keyword_rank")),
        "query_id",
    )
    metrics = ranks.agg(
        accuracy().alias("acc_at_k"),
        mean_reciprocal_rank().alias("mrr_at_k"),
        accuracy("keyword_rank").alias("keyword_acc_at_k"),
        F.count(F.lit(1)).alias("labelled"),
    )
    return Evaluation(metrics, predictions(hits, labels))


def compare_listed(
    models: Mapping[str, tuple[DataFrame, Loader]], corpus: DataFrame, k: int = 5
) -> DataFrame:
    """``(model, mrr, queries)``: the reciprocal rank of the first listed document, by model.

    Each model has its queries ``(query_id, text, related_documents)`` and its loader.
    """
    hits, listed = [], []
    for name, (queries, load) in models.items():
        found, _ = stage(search(queries, corpus, load, k), "hits")
        hits.append(found.withColumn("model", F.lit(name)))
        wanted = queries.select("query_id", "related_documents")
        listed.append(wanted.withColumn("model", F.lit(name)))
    return first_listed_mrr(union_by_name(hits), union_by_name(listed), ["model"])


def label_queries(labels: DataFrame) -> DataFrame:
    """``(query_id, query, query_fr, doc_id)`` of a label table; equal rows get ids of their own."""
    rows = labels.select("query", F.col("query-fr").alias("query_fr"), "doc_id")
    # copies are counted first and numbered from the count: none of them is gathered
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    numbered = counted.select("query", "query_fr", "doc_id", number.alias("number"))
    row = F.md5(F.to_json(F.struct("query", "query_fr", "doc_id")))
    return numbered.select(
        F.concat_ws("-", row, F.col("number").cast("string")).alias("query_id"),
        "query",
        "query_fr",
        "doc_id",
    )


def evaluate_files(
    spark: SparkSession,
    labels_path: str,
    records_path: str,
    output_dir: str,
    load: Loader,
    model: str,
    language: str = "en",
    k: int = 5,
) -> DataFrame:
    """Evaluate ``model`` on a label CSV and a record table; writes the predictions.

    Returns the one-row metrics. Records are searched by their plain text in ``language``.
    """
    records = read_table(spark, records_path).select(
        F.col(fv.ID).alias("doc_id"), plain_record_text(language).alias("text")
    )
    queries = label_queries(read_label_queries(spark, labels_path))
    result = evaluate_search(queries, records, load, k)
    write_predictions(result.predictions, output_dir, model)
    return result.metrics


def main(argv: Sequence[str] | None = None) -> None:
    """Evaluate a model from the command line; prints the metrics as JSON."""
    parser = argparse.ArgumentParser(description="Evaluate a model on labelled queries.")
    parser.add_argument("--labels", required=True, help="CSV of labelled queries")
    parser.add_argument("--records", required=True, help="parquet table of records")
    parser.add_argument("--output-dir", required=True, help="folder the predictions go to")
    parser.add_argument("--loader", required=True, help="module:function that loads the model")
    parser.add_argument("--model", required=True, help="name the predictions are written under")
    parser.add_argument("--language", default="en")
    parser.add_argument("--k", type=int, default=5)
    a = parser.parse_args(argv)
    module, _, function = a.loader.partition(":")
    load = getattr(importlib.import_module(module), function)
    spark = SparkSession.builder.appName("evaluate").getOrCreate()
    metrics = evaluate_files(
        spark, a.labels, a.records, a.output_dir, load, a.model, a.language, a.k
    )
    print(metrics.toJSON().first())


if __name__ == "__main__":
    main()

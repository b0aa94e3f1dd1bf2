"""Documents to training tokens, in five stages.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``docs``. Rows with one doc_id
are treated as one document; a null doc_id is a document that nothing is joined to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep_spark.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from textprep_spark.llm.common import stage, table, unused

ORACLE_SQL = None  # learned rules, tilted rates and byte-pair merges are not expressible in SQL


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned one go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = unused(docs, "__stats")
    judged = docs.withColumn(name, quality_rules.text_stats(docs))
    stats = F.col(name)
    rejected = rules.first_match(quality_rules.features(stats)).isNotNull()
    kept = judged.where(~quality_rules.base_failed(stats) & ~rejected)
    return kept.select(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; no document does."""
    left = line_dedup.dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least id."""
    judged = near_dedup.near_duplicates(docs.select("doc_id", "text"))
    gone = judged.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(stage(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those it leaves out go."""
    mixed = mixing.mix(docs.select("doc_id", "source", "text"))
    id_, copies, copy = unused(docs, "__id", "__copies", "__copy")
    times = mixed.groupBy("doc_id").agg(F.max("copies").alias(copies)).where(F.col(copies) > 0)
    times = stage(times.withColumnRenamed("doc_id", id_), "copies")
    taken = docs.join(times, F.col("doc_id").eqNullSafe(F.col(id_)))
    each = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)
    return taken.select(*docs.columns, each).drop(copy)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, intact): token ids, and whether they decode to the text."""
    import public_tokenizers

    codec = bpe.byte_bpe(
        spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )
    coded = docs.select("doc_id", "source", "text", codec.round_trip(F.col("text")).alias("coded"))
    plain = F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id",
        "source",
        F.size("coded.ids").cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        (F.col("coded.decoded") == plain).alias("intact"),
    )


STAGES = [
    ("quality rules", reject_poor),
    ("line dedup", remove_lines),
    ("MinHash near-dedup", remove_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

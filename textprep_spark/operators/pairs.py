"""Text pairs cut from record texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.functions import sentences as S

Splitter = Callable[[Column], Column]


def adjacent_pairs(
    df: DataFrame, record_id: str, text: str, splitter: Splitter = S.split_sentences
) -> DataFrame:
    """``(record_id, pos, text_a, text_b)``: every sentence with its successor, ``pos`` from 0.

    ``splitter`` maps a text column to an array of sentences; a pandas UDF will do.
    """
    cut = df.select(F.col(record_id).alias("record_id"), splitter(F.col(text)).alias("sentences"))
    return cut.select("record_id", F.posexplode(S.adjacent(F.col("sentences"))).alias("pos", "pair")).select(
        "record_id", "pos", "pair.text_a", "pair.text_b"
    )


def text_halves(
    df: DataFrame, record_id: str, text: str, splitter: Splitter = S.split_sentences
) -> DataFrame:
    """``(record_id, text_a, text_b)``: each text cut at its middle sentence."""
    cut = df.select(F.col(record_id).alias("record_id"), splitter(F.col(text)).alias("sentences"))
    return cut.withColumn("half", S.halves(F.col("sentences"))).select(
        "record_id", "half.text_a", "half.text_b"
    )

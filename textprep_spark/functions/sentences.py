"""Sentence splitting by rule, and what training pairs are cut from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_sentences(c: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` followed by white space; empty ones are dropped."""
    return F.array_remove(F.split(c, r"(?<=[.!?])\s+"), F.lit(""))


def adjacent(sentences: Column) -> Column:
    """Array of ``struct(text_a, text_b)``: each sentence with the one after it."""
    n = F.greatest(F.size(sentences) - 1, F.lit(0))
    return F.arrays_zip(
        F.slice(sentences, F.lit(1), n).alias("text_a"),
        F.slice(sentences, F.lit(2), n).alias("text_b"),
    )


def halves(sentences: Column) -> Column:
    """``struct(text_a, text_b)``: the sentences before and from the middle, space-joined."""
    n = F.size(sentences)
    middle = F.floor(n / 2).cast("int")
    return F.struct(
        F.array_join(F.slice(sentences, F.lit(1), middle), " ").alias("text_a"),
        F.array_join(F.slice(sentences, middle + 1, n), " ").alias("text_b"),
    )

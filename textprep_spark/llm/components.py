"""Connected components of links, by alternating stars.

In a round every node's larger neighbours are linked to the least node of its neighbourhood, then
its smaller ones. The number of links never grows, no neighbourhood is ever gathered in one place,
and after a logarithmic number of rounds every component is a star around its least node. Each
round is staged, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import release, stage


def _linked(df: DataFrame, a: str, b: str) -> DataFrame:
    pairs = df.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    return pairs.where("high <> low").distinct()


def _state(df: DataFrame) -> tuple:
    mark = F.xxhash64("high", "low").cast("decimal(38,0)")
    return tuple(df.agg(F.count("*"), F.sum(mark)).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every linked node; ``component`` is its least reachable node.

    ``links`` holds pairs of integers in any order, also repeated; self-links say nothing.
    """
    stars = stage(_linked(links, a, b), "links")
    state = _state(stars)
    while True:
        last = stars
        both = stars.select(F.col("high").alias("u"), F.col("low").alias("v")).union(
            stars.select("low", "high")
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select("v", "m")
        stars = _linked(larger, "v", "m")
        least = stars.groupBy("high").agg(F.min("low").alias("m"))
        smaller = stars.join(least, "high")
        stars = smaller.select("low", "m").union(least.select("high", "m"))
        stars = stage(_linked(stars, "low", "m"), "links")
        release(last)
        before, state = state, _state(stars)
        if state == before:
            break
    centres = stars.select(F.col("low").alias("node")).distinct()
    return stars.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        centres.select("node", F.col("node").alias("component"))
    )

"""Adding tags from lookup tables to records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions.themes import append_tags

Lookup = tuple[DataFrame, Sequence[str] | None]


def _usable(lookup: DataFrame, allowed: Sequence[str] | None) -> DataFrame:
    rows = lookup.where(F.col("uuid").isNotNull() & (F.col("tag") != ""))
    return rows if allowed is None else rows.where(F.col("tag").isin(list(allowed)))


def _stacked(lookups: Sequence[Lookup]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            _usable(lookup, allowed).select("uuid", "tag", F.lit(i).alias("origin"))
            for i, (lookup, allowed) in enumerate(lookups)
        ],
    )


def tags_per_record(lookups: Sequence[Lookup]) -> DataFrame:
    """``(uuid, tags_0, tags_1, ...)``: sorted distinct usable tags of each ``(uuid, tag)`` lookup.

    One aggregation for all lookups. Sets are built before the shuffle, so a record listed very
    often costs each map task one set of its different tags.
    """

    def tags_of(i: int) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("origin") == i, F.col("tag"))))

    names = [f"tags_{i}" for i in range(len(lookups))]
    return _stacked(lookups).groupBy("uuid").agg(*[tags_of(i).alias(n) for i, n in enumerate(names)])


def enrich(
    df: DataFrame,
    lookups: Sequence[Lookup],
    key: str = fv.ID,
    themes: str = fv.P + "geo_theme",
    join_hint: str | None = None,
) -> DataFrame:
    """Append the tags of every ``(lookup, allowed tags)`` to each record's themes, in turn.

    The lookups are merged first, so the records are joined once. How is left to adaptive
    execution, which knows the merged lookup's size by then, unless ``join_hint`` says it. No record
    is multiplied or lost.
    """
    if not lookups:
        return df
    tags = tags_per_record(lookups)
    if join_hint is not None:
        tags = tags.hint(join_hint)
    out = df.join(tags, df[key] == tags["uuid"], "left")
    for i in range(len(lookups)):
        out = out.withColumn(themes, append_tags(F.col(themes), F.col(f"tags_{i}")))
    return out.drop("uuid", *[f"tags_{i}" for i in range(len(lookups))])

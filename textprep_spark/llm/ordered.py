"""Places, running sums and successors along a global order, without one task that sees all rows.

Rows are dealt by ranges of the order and numbered within each range; what a range needs to know of
the others is a row or two a range, so the number of partitions bounds what is summed in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep_spark.llm.common import stage

PLACES = 33  # bits of ``at`` that count within a range


def in_order(df: DataFrame, order: Sequence[Column | str], columns: Sequence[Column | str], name: str) -> DataFrame:
    """``columns`` of ``df``, staged, with ``at``: an integer that grows along the order.

    Rows that the order does not tell apart should be alike in ``columns``.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    return stage(placed.select("at", *columns), name)


def _part(at: str = "at") -> Column:
    return F.shiftright(at, PLACES)


def running(df: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Adds sums of all rows up to each, within equal ``by`` if given.

    ``df`` comes from ``in_order`` with an order that begins with ``by``, which holds no nulls. A
    range's sums begin with what earlier ranges hold of its first group.
    """
    inside = Window.partitionBy("part", *by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = df.withColumn("part", _part())
    totals = parts.groupBy("part", *by).agg(
        *[F.sum(value).alias(f"in_{n}") for n, value in sums.items()], F.min("at").alias("low"), F.max("at").alias("high")
    )
    if by:  # only the first and the last group of a range can go on in another
        ends = totals.groupBy("part").agg(F.min("low").alias("first"), F.max("high").alias("last"))
        totals = totals.join(F.broadcast(ends), "part").where("low = first or high = last")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "part", *by, *[F.sum(f"in_{n}").over(before).alias(f"before_{n}") for n in sums]
    ).where(" or ".join(f"before_{n} is not null" for n in sums))
    parts = parts.select("*", *[F.sum(value).over(inside).alias(f"in_{n}") for n, value in sums.items()])
    parts = parts.join(F.broadcast(carried), ["part", *by], "left")
    zero = F.lit(0)
    return parts.select(
        *df.columns, *[(F.col(f"in_{n}") + F.coalesce(f"before_{n}", zero)).alias(n) for n in sums]
    )


def followed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``after``, a struct of ``columns`` of the next row in the order, null for the last.

    ``df`` comes from ``in_order``.
    """
    row = F.struct(*columns)
    parts = df.withColumn("part", _part())
    heads = parts.groupBy("part").agg(F.min_by(row, "at").alias("head"))
    heads = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("head"))
    inside = Window.partitionBy("part").orderBy("at")
    parts = parts.withColumn("inside", F.lead(row).over(inside))
    parts = parts.join(F.broadcast(heads), "part", "left")
    return parts.select(*df.columns, F.coalesce("inside", "head").alias("after"))

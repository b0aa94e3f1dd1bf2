"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``most`` that give every source its target number of words,
the one nearest to given base rates, in relative entropy per word, is an exponential tilt of them
stopped at the bound: ``rate = min(most, base * exp(tilt))`` with one tilt for each source, the
multiplier of its word constraint. The dual is convex and, as no document has two sources, separates by
source. Words are summed by source and base rate first; Newton's iterations then run on those few
sums, for all sources at once on the executors. In ``exp(tilt)`` the constraint is concave and
piecewise linear, so the iterations climb to the exact solution in at most one step per base rate.

Rates become whole copies by carrying the rounding error on from document to document, the largest
first, so that small documents settle what large ones leave open. Every source is dealt over blocks
of about ``BLOCK`` documents by a hash of their ids, each rounded on its own: no task gets a source.

Null texts have size 0. Documents without a source form a source of their own, ranked last.
Repeated rows are documents of their own. A source without words has target 0. Empty tables give an
empty result. Equal input gives equal copies, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep_spark.llm.common import stage, words_of
from textprep_spark.shipping import ship

BLOCK = 4096  # documents rounded together
STEP = 64  # base rates are multiples of 1 / STEP
SHORT_WORDS = 50


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long")


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def length_base(size: Column) -> Column:
    """Documents too short to teach much are repeated half as readily."""
    return F.when(size < SHORT_WORDS, 0.5).otherwise(1.0)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` staged with ``rank``, from 0: its place by ``key``, null last.

    Sorted by ranges; only the number of rows of each range is summed up in one task.
    """
    order = F.col(key).asc_nulls_last()
    parts = df.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    parts = stage(parts, "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = parts.withColumn("place", place).join(sizes, "part")
    return numbered.withColumn("rank", F.col("place") + F.col("before")).drop(
        "part", "place", "before"
    )


def targets(
    sources: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """Adds ``target``: the words of each source, ``share`` of all by weight, at most ``most`` times
    its own.

    ``sources`` (source, source_size, n_docs). What a source cannot take is shared out among the
    others by weight. Every round is one sum over the sources.
    """
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    limit = most * F.col("source_size")
    weighed = stage(
        ranked(sources, "source").select("*", weight.alias("weight"), limit.alias("limit")),
        "sources",
    )
    goal = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("limit")
        capped, taken, open_ = weighed.agg(
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if capped == full or not open_:
            break
        level, full = (goal - taken) / open_, capped
    target = F.least(F.col("weight") * level, F.col("limit"))
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def solve_tilts(cells: DataFrame, most: float) -> DataFrame:
    """(source, tilt factor ``exp(tilt)``) from ``cells`` (source, target, base, words)."""
    grouped = cells.groupBy("source").agg(
        F.first("target").alias("target"), F.collect_list(F.struct("base", "words")).alias("cells")
    )

    def total(value) -> Column:
        return F.aggregate("cells", F.lit(0.0), lambda sum_, c: sum_ + value(c))

    def newton(factor: Column, _: Column) -> Column:
        full = total(lambda c: F.when(c["base"] * factor >= most, most * c["words"]).otherwise(0.0))
        slope = total(
            lambda c: F.when(c["base"] * factor < most, c["base"] * c["words"]).otherwise(0.0)
        )
        return F.when(slope > 0, (F.col("target") - full) / slope).otherwise(factor)

    steps = F.sequence(F.lit(0), F.size("cells"))
    return grouped.select("source", F.aggregate(steps, F.lit(0.0), newton).alias("factor"))


def _copies(sizes: np.ndarray, rates: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    copies, carried = np.zeros(len(sizes), dtype=np.int64), 0.0
    for i in order.tolist():
        size = float(sizes[i])
        if size == 0:
            continue
        wanted = rates[i] * size + carried
        copies[i] = n = min(max(math.floor(wanted / size + 0.5), 0), most)
        carried = wanted - n * size
    return copies


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    base=length_base,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every document.

    ``documents`` (doc_id, source, text). ``weights`` repeat along the sources in code-point order.
    ``base`` gives the base rate from the size column, positive and at most ``most``.
    """
    spark = documents.sparkSession
    ship(spark)
    size = word_count(_known(F.col("text")))
    # without an id, the text tells rows apart
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(1))).otherwise(F.xxhash64("doc_id"))
    sized = stage(documents.select("doc_id", "source", size.alias("size"), mark.alias("mark")), "sizes")
    grid = F.greatest(F.round(base(F.col("size")) * STEP), F.lit(1.0)) / STEP
    sized = sized.withColumn("base", F.least(grid, F.lit(float(most))))
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    aims = targets(totals, weights, share, float(most))
    words = sized.groupBy("source", "base").agg(F.sum("size").cast("double").alias("words"))
    cells = words.alias("w").join(aims.alias("a"), F.expr("w.source <=> a.source"))
    tilts = solve_tilts(cells.select("w.source", "target", "base", "words"), float(most))
    known = aims.alias("a").join(tilts.alias("t"), F.expr("a.source <=> t.source"))
    known = stage(known.select("a.*", "factor"), "tilts")
    rated = sized.alias("d").join(known.alias("k"), F.expr("d.source <=> k.source"))
    rate = F.least(F.col("base") * F.col("factor"), F.lit(float(most)))
    blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK), F.lit(1)).cast("long")
    rated = rated.select(
        "doc_id",
        "d.source",
        "size",
        "source_size",
        "target",
        rate.alias("rate"),
        "mark",
        F.pmod(F.shiftright("mark", 7), blocks).alias("block"),
    )

    def rounded(block: pa.Table) -> pa.Table:
        sizes, marks = block["size"].to_numpy(), block["mark"].to_numpy()
        order = np.lexsort((marks, -sizes))
        copies = _copies(sizes, block["rate"].to_numpy(), order, most)
        out = block.drop_columns(["mark", "block"])
        out = out.append_column("copies", pa.array(copies))
        return out.append_column("taken", pa.array(copies * sizes))

    return rated.groupBy("source", "block").applyInArrow(
        rounded,
        "doc_id long, source string, size long, source_size long, target double, rate double, "
        "copies long, taken long",
    )

"""Keep-first removal of duplicates, one column after another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def content_key(c: Column) -> Column:
    """Short stand-in for a long text when grouping; null stays null."""
    return F.unhex(F.sha2(c, 256))


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per value of ``key`` (nulls count as one value): the first in ``order``.

    Spark cuts each map task's rows to one per key before the shuffle (WindowGroupLimit), so a
    value held by a large share of the rows costs at most one row per task downstream.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def deduplicate(
    df: DataFrame, columns: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Pass over ``columns`` in turn, each pass keeping the first row per value of its column
    among the survivors of the pass before.

    ``order`` says what "first" means; rows equal in it are told apart by a hash of the row, so
    the outcome does not depend on how the data is laid out.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    hashable = [n for n, k in kinds.items() if not isinstance(k, (T.MapType, T.VariantType))]
    ranked = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked.append(F.col("__tie"))
    df = df.withColumn("__tie", F.xxhash64(*hashable))
    for name in columns:
        if isinstance(kinds[name], T.StringType):
            keyed = df.withColumn("__key", content_key(F.col(name)))
            df = keep_first(keyed, "__key", ranked).drop("__key")
        else:
            df = keep_first(df, name, ranked)
    return df.drop("__tie")

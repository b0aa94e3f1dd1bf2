"""Column clean-up and row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep_spark import fixed_values as fv
from textprep_spark.functions.text import split_list


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, in that order; raises naming every one that is absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are absent: {absent}")
    return df.select(*columns)


def placeholder_to_null(c: Column, placeholders: Sequence[str]) -> Column:
    """Null where the whole value is one of ``placeholders``."""
    return F.when(~c.isin(list(placeholders)), c)


def source_or_default(c: Column) -> Column:
    """The source system name, with the legacy name and nulls replaced by the default."""
    return F.when(c == fv.LEGACY_SOURCE, F.lit(fv.DEFAULT_SOURCE)).otherwise(
        F.coalesce(c, F.lit(fv.DEFAULT_SOURCE))
    )


def as_list(df: DataFrame, name: str) -> Column:
    """Comma text as an array of stripped items; arrays stay; anything else is empty."""
    kind = df.schema[name].dataType
    empty = F.array().cast("array<string>")
    if isinstance(kind, T.StringType):
        return split_list(F.col(name))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.col(name).cast("array<string>"), empty)
    return empty


def lists_from_text(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({name: as_list(df, name) for name in names})


def temporal_extent(df: DataFrame) -> DataFrame:
    """Replace the two extent columns by one ``struct(begin, end)`` without placeholders."""
    begin, end = fv.P + "temporalExtent_begin", fv.P + "temporalExtent_end"
    gone = [fv.NOT_AVAILABLE, fv.STILL_RUNNING]
    return df.withColumn(
        "temporalExtent",
        F.struct(
            placeholder_to_null(F.col(begin), gone).alias("begin"),
            placeholder_to_null(F.col(end), gone).alias("end"),
        ),
    ).drop(begin, end)


def clean_dates(df: DataFrame) -> DataFrame:
    names = [fv.P + "date_published_date", fv.P + "date_created_date"]
    return df.withColumns({n: placeholder_to_null(F.col(n), [fv.NOT_AVAILABLE]) for n in names})


def drop_eo(df: DataFrame) -> DataFrame:
    """Keep records that belong to no earth-observation collection."""
    return df.where(F.col(fv.EO_COLLECTION).isNull())


def drop_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep rows in which every one of ``names`` has a value; NaN is none.

    A test on a column that cannot be null is dropped from the plan, where ``dropna`` would
    compute the column once more in a filter.
    """
    present = F.lit(True)
    for name in names:
        present = present & F.col(name).isNotNull()
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            present = present & ~F.isnan(name)
    return df.where(present)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order).limit(n)

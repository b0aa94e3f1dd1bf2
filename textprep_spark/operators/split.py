"""Exact, repeatable train / eval / test split without sorting the data.

Rows are ordered by ``md5(seed | identity)``; the first rows in that order are the test set, the
next ones the eval set, the rest is for training. Sizes are exact because the two boundary rows
are located by counting: a histogram over the next three hex digits of the key says which bucket
holds each boundary, and only rows in those buckets are counted again, three digits deeper, until
the boundary falls between two buckets. A histogram has at most 4,096 rows per boundary, whatever the data
size, and nothing else reaches the driver. Assigning a row is then a comparison with two strings:
no shuffle, no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 3
HASH_DIGITS = 32
KEY = "__split_key"
SALTS = 1024  # parts that the rows of one key are numbered in
COPIES = 100_000  # of one row that are written out in one place, at most


def split_key(seed: int, identity: Sequence[str | Column]) -> Column:
    """Hex key a row is ordered by.

    A single column counts by its plain text, several by their JSON text.
    """
    if len(identity) == 1:
        only = identity[0]
        text = (F.col(only) if isinstance(only, str) else only).cast("string")
    else:
        text = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(text, F.lit(""))))


@dataclass(frozen=True)
class Sizes:
    total: int
    test: int
    eval: int
    train: int


def split_sizes(total: int, holdout: float | int) -> Sizes:
    """Exact set sizes: the holdout share rounds up, and its test half rounds up again.

    An integer ``holdout`` is a row count.
    """
    held = holdout if isinstance(holdout, int) else math.ceil(holdout * total)
    if not 0 <= held <= total:
        raise ValueError(f"holdout {holdout} does not fit {total} rows")
    test = math.ceil(held * 0.5)
    return Sizes(total, test, held - test, total - held)


class _Boundary:
    """Locates the key of the row at a position by descending through histograms."""

    def __init__(self, position: int, total: int, key_length: int) -> None:
        self.left = position  # rows of the current bucket that lie before the boundary
        self.count = total  # rows in the current bucket
        self.key_length = key_length
        self.prefix = ""
        self.depth = DIGITS
        self.done = position <= 0
        self.among = 0  # rows with the key ``prefix`` itself that lie before the boundary

    def before(self, key: Column, number: Column | None) -> Column:
        """Whether a row lies before the boundary; ``number`` counts the rows of one key."""
        plain = key < F.lit(self.prefix)
        if not self.among:
            return plain
        return plain | (key == self.prefix) & (number <= self.among)

    def descend(self, histogram: list[tuple[str, int]]) -> None:
        """Go on into the bucket of ``histogram`` that holds the boundary."""
        for digits, count in histogram:
            if self.left < count:
                self._enter(digits, count)
                return
            self.left -= count
        # past the last row: nothing lies behind the boundary
        self.prefix, self.done = "g", True

    def _enter(self, digits: str, count: int) -> None:
        # Rows that still agree when three more digits are looked at are copies with one
        # identity: go straight behind it.
        copies = bool(self.prefix) and count == self.count
        behind = (len(digits) // HASH_DIGITS + 1) * HASH_DIGITS + DIGITS
        self.prefix, self.count = digits, count
        self.depth = min(behind if copies else len(digits) + DIGITS, self.key_length)
        self.done = self.left == 0
        if not self.done and len(digits) >= self.key_length:
            # the boundary lies among rows of one key: so many of them go before it
            self.among, self.done = self.left, True


def _histograms(keys: DataFrame, bounds: Sequence[_Boundary]) -> list[list[tuple[str, int]]]:
    """For every boundary, its bucket's rows counted by the digits it looks at next."""
    wanted = {b.prefix: b.depth for b in bounds}
    inside = {p: F.startswith(F.col(KEY), F.lit(p)) for p in wanted}
    digits = F.coalesce(*[F.when(inside[p], F.substring(KEY, 1, d)) for p, d in wanted.items()])
    counted = (
        keys.select(digits.alias("digits"))
        .where(F.col("digits").isNotNull())
        .groupBy("digits")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    pairs = sorted((r["digits"], r["n"]) for r in counted)
    return [[x for x in pairs if x[0].startswith(b.prefix)] for b in bounds]


def _thresholds(keys: DataFrame, holdout: float | int, key_length: int) -> list[_Boundary]:
    first = _histograms(keys, [_Boundary(1, 0, key_length)])[0]
    sizes = split_sizes(sum(n for _, n in first), holdout)
    ends = (sizes.test, sizes.test + sizes.eval)
    bounds = [_Boundary(end, sizes.total, key_length) for end in ends]
    open_bounds, histograms = [b for b in bounds if not b.done], [first, first]
    while open_bounds:
        for b, histogram in zip(open_bounds, histograms):
            b.descend(histogram)
        open_bounds = [b for b in open_bounds if not b.done]
        histograms = _histograms(keys, open_bounds) if open_bounds else []
    return bounds


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number from 1 within their key, whichever row gets which.

    A key can hold most of a table, and one row can stand there any number of times. Equal rows are
    counted, the others dealt over ``SALTS`` by a hash; every salt is numbered for itself, behind the
    rows of the salts before it. Rows that are repeated very often are written out in blocks, each a
    row of its own until it has been dealt out.
    """
    columns = rows.columns
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    plain = [c for c in columns if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    one_each = rows.groupBy(*columns).agg(F.count("*").alias("__n")) if len(plain) == len(columns) else rows.withColumn("__n", F.lit(1))
    mark = F.xxhash64(*plain)
    salted = one_each.withColumn("__mark", mark).withColumn("__salt", F.pmod(mark, F.lit(SALTS)).cast("int"))
    earlier = Window.partitionBy(KEY).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy(KEY, "__salt").agg(F.sum("__n").alias("__all"))  # two keys, SALTS each, at most
    totals = totals.select(KEY, "__salt", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(KEY, "__salt").orderBy("__mark").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum("__n").over(inside) + F.col("__before")
    placed = salted.join(F.broadcast(totals), [KEY, "__salt"]).withColumn("__first", last - F.col("__n") + 1)
    own = [F.col(f"`{c}`") for c in columns]

    def written(df: DataFrame) -> DataFrame:
        return df.select(*own, F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)).alias(name))

    often = F.col("__n") > COPIES
    starts = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))
    blocks = placed.where(often).select(*own, "__first", "__n", F.explode(starts).alias("__at"))
    blocks = blocks.select(
        *own,
        (F.col("__first") + F.col("__at")).alias("__first"),
        F.least(F.col("__n") - F.col("__at"), F.lit(COPIES)).alias("__n"),
    )
    # a number, so that these few rows, which become many, are not put together again
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(placed.where(~often)).unionByName(written(blocks.repartition(n, "__first")))


def assign_by_key(
    df: DataFrame, key: Column, holdout: float | int = 0.1, key_length: int = HASH_DIGITS
) -> DataFrame:
    """``df`` with a ``split`` column: ``train``, ``eval`` or ``test``, by order of ``key``.

    Runs one small counting job per three digits needed, which reads the key's columns only.
    """
    bounds = _thresholds(df.select(key.alias(KEY)), holdout, key_length)

    def assigned(rows: DataFrame, number: Column | None = None) -> DataFrame:
        test, held = (b.before(key, number) for b in bounds)
        return rows.withColumn(
            "split", F.when(test, "test").when(held, "eval").otherwise("train")
        )

    repeated = {b.prefix for b in bounds if b.among}
    if not repeated:
        return assigned(df)
    # rows of one key are interchangeable: only those at a boundary are numbered
    at_bound = F.coalesce(key.isin(sorted(repeated)), F.lit(False))
    copies = _numbered(df.where(at_bound).withColumn(KEY, key), "__number")
    copies = assigned(copies, F.col("__number")).drop(KEY, "__number")
    return assigned(df.where(~at_bound), F.lit(0)).unionByName(copies)


def assign_split(
    df: DataFrame,
    holdout: float | int = 0.1,
    seed: int = 42,
    identity: Sequence[str | Column] | None = None,
    tie_break: Sequence[Column] = (),
) -> DataFrame:
    """The same with a key made from ``identity`` (all columns when not given).

    Set sizes are exact whatever the identity. Rows of one identity go to one set, but for those
    at a boundary, of which as many as needed go before it. ``tie_break`` extends the key: for a
    table read from files, ``_metadata.file_path`` and ``_metadata.row_index`` tell any rows apart.
    """
    key = split_key(seed, list(identity or df.columns))
    if not tie_break:
        return assign_by_key(df, key, holdout)
    return assign_by_key(df, F.concat(key, split_key(seed, list(tie_break))), holdout, 2 * HASH_DIGITS)


def split_frames(assigned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The train, eval and test frames of an assigned frame."""
    train, held, test = (
        assigned.where(F.col("split") == name).drop("split") for name in ("train", "eval", "test")
    )
    return train, held, test

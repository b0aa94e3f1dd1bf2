"""URL filters: host and path rules, and exact membership in a list without a join.

A Bloom filter says "listed" for some keys that are not. A cascade mends that for every key of a
known universe: level 1 holds the listed keys, level 2 the unlisted keys that pass level 1, level 3
the listed keys that pass level 2, and so on until nobody passes wrongly. The first level that
rejects a key decides, so the cascade is exact on its universe, at a few bits a key. The levels are
constants of one column expression, tested in the JVM.

The constants travel with the plan, so their size is checked: with more than ``MAX_BYTES`` the same
question is answered by a join with the listed keys.

Null URLs and those without ``://`` have empty host and path. Null keys are never listed. Repeated
rows are judged each; repeated keys count once. An empty list lists nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import lower_ascii, stage

FALSE_SHARE = 0.02  # of the keys outside a level that pass it
MAX_BYTES = 4 << 20  # of all levels together
BITS = 7  # used of each byte: every byte is then an ASCII character


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*+", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return host, path


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith("." + self.host)
        return inside & path.startswith(self.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else nulls."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = rule.fits(host, path)
        name = F.when(fits, rule.name).otherwise(name)
        action = F.when(fits, rule.action).otherwise(action)
    return name, action


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``bits`` of them, packed seven to a byte."""

    packed: bytes
    bits: int
    hashes: int
    number: int

    def _places(self, key: Column) -> list[Column]:
        return places(key, self.bits, self.hashes, self.number)

    def passes(self, key: Column) -> Column:
        packed, every = F.lit(self.packed), F.lit(True)
        for place in self._places(key):
            at = F.floor(place / BITS).cast("int")
            byte = F.ascii(F.substr(packed, at + 1, F.lit(1)).cast("string"))
            every = every & (F.getbit(byte, (place % BITS).cast("int")) == 1)
        return every


def places(key: Column, bits: int, hashes: int, number: int) -> list[Column]:
    """The bits of a key in a level; every level hashes in its own way."""
    return [
        F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(bits).cast("long"))
        for i in range(hashes)
    ]


def _level(keys: DataFrame, n: int, number: int) -> Level:
    bits = max(64, math.ceil(-n * math.log(FALSE_SHARE) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2))) if n else 1
    hashes = min(hashes, 8)
    place = keys.select(F.explode(F.array(*places(F.col("key"), bits, hashes, number))).alias("p"))
    bytes_ = place.groupBy(F.floor(F.col("p") / BITS).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % BITS).cast("int"))).alias("b")
    )
    packed = bytearray(math.ceil(bits / BITS))
    for at, byte in bytes_.collect():  # as many as the level has bytes, at most
        packed[at] = byte
    return Level(bytes(packed), bits, hashes, number)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            # rejected by an odd level: not listed; by an even one: listed
            answer = F.when(level.passes(key), answer).otherwise(level.number % 2 == 0)
        return F.coalesce(answer & key.isNotNull(), F.lit(False))


def build_cascade(keys: DataFrame) -> Cascade | None:
    """The cascade of ``keys`` (key, listed), one row per key; None if it would be too large."""
    held = keys.where(F.col("listed"))
    others = keys.where(~F.col("listed"))
    levels: list[Level] = []
    size = 0
    while n := held.count():
        size += math.ceil(-n * math.log(FALSE_SHARE) / math.log(2) ** 2 / BITS)
        if size > MAX_BYTES:
            return None
        level = _level(held, n, len(levels) + 1)
        levels.append(level)
        held, others = others.where(level.passes(F.col("key"))), held
    return Cascade(tuple(levels))


def universe(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed), one row per key that stands in either frame, staged."""
    both = keys.select("key", F.lit(False).alias("listed")).unionByName(
        listed.select("key", F.lit(True).alias("listed"))
    )
    both = both.where("key is not null").groupBy("key")
    return stage(both.agg(F.bool_or("listed").alias("listed")), "keys")


def with_membership(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean column ``name``: is ``key`` listed in ``keys`` (key, listed)?

    Every key of ``df`` must be in ``keys``.
    """
    cascade = build_cascade(keys)
    if cascade is not None:
        return df.withColumn(name, cascade.lists(key))
    listed = keys.where("listed").select(F.col("key").alias("__key"))
    joined = df.withColumn("__own", key).join(listed, F.col("__own") == F.col("__key"), "left")
    return joined.withColumn(name, F.col("__key").isNotNull()).drop("__own", "__key")


def judge(
    pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_column: str = "page_id"
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    ``listed`` (key) holds ``host`` followed by ``path`` of unwanted URLs. A fitting rule decides;
    without one, listed URLs are blocked and others allowed.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select(id_column, host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    keys = universe(parts.select(key.alias("key")), listed)
    marked = with_membership(parts, key, keys, "listed")
    name, action = longest_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select(
        id_column, "host", "path", name.alias("rule"), F.coalesce(action, method).alias("verdict")
    )

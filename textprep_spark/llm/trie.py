"""The prefix trie of conversations, by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations that begin with it.
A prefix is told apart by two 64-bit hashes of its turns and their places, summed up: a running sum,
so that a conversation of any length is dealt over tasks. Grouping by depth and sums gives the nodes,
named by depth and least member.

The tour walks around the tree: every node has an arc that enters it and one that leaves it. An
entering arc is followed by that of the first child, or by the node's own leaving arc; a leaving arc
by the next sibling's entering one, or by the parent's leaving one. Nodes lie in one global order by
parent, so siblings are neighbours, however many there are.

The tour is a linked list. Its arcs are ranked by contraction: in every round each arc tosses a coin,
and arcs with heads whose predecessor has tails are spliced out, a quarter of them in the mean, until
``FEW`` are left; then the rounds are unrolled. Work is in proportion to the arcs, a round is one join,
and the coins are hashes, so a rerun gives the same. With the arcs in the order of their ranks, running
sums of what nodes weigh give every subtree's total: the sum at its leaving arc less that in front of
its entering arc.

Rows with a null conv_id belong to no conversation and are left out; null roles and texts are empty;
turns are ordered by turn, null first, then by role and text; repeated rows are turns of their own. No
conversations, no nodes. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep_spark.llm.common import stage, words_of
from textprep_spark.llm.ordered import followed, in_order, running
from textprep_spark.shipping import ship

FEW = 1 << 14  # arcs that are ranked on the driver, at most
IDS = 12  # bits: so many ids, to a power of two, are joined to one string

_SUM = "decimal(38,0)"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, words) of every turn: its place in its conversation, from 0, two hashes
    of role and text, and the words of the text. Texts are shuffled once and go no further."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", role, text)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    said = F.struct("role", "text")
    narrow = [
        "conv_id",
        F.xxhash64(said).alias("a"),
        F.xxhash64(said, F.lit(1)).alias("b"),
        F.size(words_of(F.col("text"))).cast("long").alias("words"),
    ]
    placed = running(in_order(turns, order, narrow, "turns"), {"number": F.lit(1)}, ["conv_id"])
    return placed.select("conv_id", (F.col("number") - 1).alias("place"), "a", "b", "words")


def _prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, words, s, t, p, q, last): sums that tell every prefix of a conversation apart,
    and those of the prefix one turn shorter; ``last``: whether it is the whole conversation."""
    none = F.lit(0).cast(_SUM)
    placed = turns.select(
        "conv_id",
        "depth",
        "words",
        F.xxhash64("depth", "a").cast(_SUM).alias("x"),
        F.xxhash64("depth", "b", F.lit(1)).cast(_SUM).alias("y"),
    )
    starts = conversations.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), none.alias("x"), none.alias("y")
    )
    rows = in_order(starts.unionByName(placed), ["conv_id", "depth"], ["conv_id", "depth", "words", "x", "y"], "prefixes")
    rows = followed(rows, ["conv_id"])
    rows = running(rows, {"s": F.col("x"), "t": F.col("y")}, ["conv_id"])
    shorter = [F.when(F.col("depth") > 0, F.col(c) - F.col(own)).alias(n) for c, own, n in (("s", "x", "p"), ("t", "y", "q"))]
    last = ~F.coalesce(F.col("after.conv_id") == F.col("conv_id"), F.lit(False))
    return rows.select("conv_id", "depth", "words", *[F.col(c).cast(_SUM).alias(c) for c in "st"], *shorter, last.alias("last"))


def _digests(prefixes: DataFrame) -> DataFrame:
    """(depth, s, t, ends_sha256) of the nodes at which conversations end.

    Ids are put in order and joined to strings of a few thousand wherever they lie; one pass per
    node hashes the strings one after the other and holds none but the one at hand.
    """
    key = ["depth", "s", "t"]
    ends = in_order(prefixes.where("last"), [*key, "conv_id"], [*key, "conv_id"], "ends")
    chunk = F.shiftright("at", IDS).alias("chunk")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    strings = ends.groupBy(*key, chunk).agg(F.array_join(ids, ",").alias("ids"))
    named = F.concat_ws(":", *key).alias("node")
    strings = strings.select(named, "chunk", "ids").repartition("node").sortWithinPartitions("node", "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            nodes, digests = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(digests, pa.string())], names=["node", "digest"])

        node, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for own, ids in zip(batch["node"].to_pylist(), batch["ids"].to_pylist()):
                if own == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            yield told(done)
        if node is not None:
            yield told([(node, digest.hexdigest())])

    found = strings.mapInArrow(hashed, "node string, digest string")
    parts = F.split("node", ":")
    return found.select(
        parts[0].cast("long").alias("depth"), parts[1].cast(_SUM).alias("s"), parts[2].cast(_SUM).alias("t"),
        F.col("digest").alias("ends_sha256"),
    )


def _nodes(prefixes: DataFrame) -> DataFrame:
    """Every node with its parent, its first child and its next sibling, by ``id``."""
    grouped = prefixes.groupBy("depth", "s", "t").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("words", "p", "q")]
    )
    columns = ["depth", "conv_id", "n_convs", "words", "s", "t", "p", "q"]
    placed = in_order(grouped, ["depth", "p", "q", "conv_id"], columns, "nodes")
    placed = placed.withColumnRenamed("at", "id")
    after = followed(placed.withColumn("at", F.col("id")), ["id", "depth", "p", "q"])
    same = F.expr("after.depth = depth and after.p = p and after.q = q")
    nodes = after.select("id", *columns, F.when(same, F.col("after.id")).alias("sibling"))
    children = placed.where("depth > 0").groupBy("depth", "p", "q").agg(F.min("id").alias("child"), F.count("*").alias("n_children"))
    children = children.select((F.col("depth") - 1).alias("depth"), F.col("p").alias("s"), F.col("q").alias("t"), "child", "n_children")
    above = placed.select(
        (F.col("depth") + 1).alias("depth"), F.col("s").alias("p"), F.col("t").alias("q"),
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
    )
    nodes = nodes.join(above, ["depth", "p", "q"], "left").join(children, ["depth", "s", "t"], "left")
    return stage(nodes.fillna(0, ["n_children"]), "tree")


def tour(nodes: DataFrame) -> DataFrame:
    """(arc, next) of the tour around the tree of ``nodes`` (id, child, sibling, parent)."""

    def enter(node: str) -> Column:
        return F.col(node) * 2

    def leave(node: str) -> Column:
        return F.col(node) * 2 + 1

    down = nodes.select(enter("id").alias("arc"), F.coalesce(enter("child"), leave("id")).alias("next"))
    return down.union(nodes.select(leave("id"), F.coalesce(enter("sibling"), leave("parent"))))


def ranked_list(arcs: DataFrame, few: int = FEW) -> DataFrame:
    """(arc, rank) of a linked list ``arcs`` (arc, next), the last with null; ranks from 0."""
    spark = arcs.sparkSession
    active, spliced = stage(arcs.select("arc", "next", F.lit(1).cast("long").alias("d")), "tour"), []
    while active.count() > few:
        tosses = F.lit(len(spliced))

        def heads(c: str) -> Column:
            return F.xxhash64(F.col(c), tosses).bitwiseAND(F.lit(1)) == 1

        takes = F.coalesce(~heads("arc") & heads("next"), F.lit(False)) & F.col("next").isNotNull()
        hooks = active.where(takes).select(F.col("arc").alias("by"), F.col("next").alias("arc"), F.col("d").alias("ahead"))
        marked = stage(active.withColumn("takes", takes).join(hooks, "arc", "left"), "contracted")
        gone = marked.where("by is not null")
        spliced.append(gone.select("arc", "by", "ahead"))
        longer = gone.select(F.col("by").alias("arc"), "next", (F.col("d") + F.col("ahead")).alias("d"))
        active = marked.where("by is null and not takes").select("arc", "next", "d").union(longer)
    after = {r["arc"]: (r["next"], r["d"]) for r in active.collect()}  # few
    start = set(after).difference(n for n, _ in after.values())
    ranks, arc, rank = [], next(iter(start), None), 0
    while arc is not None:
        ranks.append((arc, rank))
        arc, step = after[arc]
        rank += step
    ranks = spark.createDataFrame(ranks, "arc long, rank long")
    for gone in reversed(spliced):
        known = ranks.select(F.col("arc").alias("by"), F.col("rank").alias("start"))
        more = gone.join(known, "by").select("arc", (F.col("start") + F.col("ahead")).alias("rank"))
        ranks = stage(ranks.union(more), "ranks")
    return ranks


def _subtree_sums(nodes: DataFrame, weights: dict[str, Column], few: int) -> DataFrame:
    """(id, ...): of each weight, its sum over every node's subtree."""
    own = nodes.select("id", *[w.cast("long").alias(n) for n, w in weights.items()])
    ranks = ranked_list(tour(nodes), few).withColumn("id", F.shiftright("arc", 1))
    entering = F.col("arc") % 2 == 0
    arcs = ranks.join(own, "id").select("id", "rank", *[F.when(entering, F.col(n)).otherwise(0).alias(n) for n in weights])
    arcs = in_order(arcs, ["rank"], ["id", "rank", *weights], "arcs")
    summed = running(arcs, {f"up_to_{n}": F.col(n) for n in weights})
    # the leaving arc weighs nothing, and no sum falls along the tour
    return summed.groupBy("id").agg(
        *[(F.max(f"up_to_{n}") - F.min(f"up_to_{n}") + F.max(n)).alias(n) for n in weights]
    )


def prefix_trie(turns: DataFrame, conversations: DataFrame, few: int = FEW) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, depth from 1, a, b, words): ``a`` and ``b`` tell
    turns apart. ``conversations`` (conv_id) lists each once, those without turns too.

    Returns conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.
    """
    ship(turns.sparkSession)
    prefixes = stage(_prefixes(turns, conversations), "prefix-sums")
    nodes = _nodes(prefixes)
    weights = {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    }
    sums = _subtree_sums(nodes, weights, few)
    rows = nodes.join(sums, "id").join(_digests(prefixes), ["depth", "s", "t"], "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

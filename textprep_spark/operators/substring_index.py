"""Keyword search by an index of short substrings.

The index holds, for every substring of one to three characters, the documents that contain it. A
posting is a block of 64 documents that stand next to each other, one bit each, so there are far fewer
postings than pairs of substring and document, and most are put together before the shuffle. A document
that contains a token contains all of the token's substrings. So a token's candidates are the documents
that its rarest substrings share, and only their texts are read and searched for the token itself.

Documents are numbered along an order, by id or by any other columns. A query wants its first ``k`` in
that order, and postings are also dealt by parts along it: the first ends after ``FIRST`` documents, each
other one after ``GROWTH`` times as many as the one before. A token that ``k`` documents of the first
parts contain is not looked for in the later ones. So a common token costs some of the first documents,
however many follow, and a rare one its few. Nothing is left out: a part's candidates are all verified.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep_spark.functions.text import keyword_tokens
from textprep_spark.sources.writers import stage

SIZE = 3  # characters of the longest indexed substring
RAREST = 3  # substrings of a token whose postings are intersected
FIRST, GROWTH = 16, 16  # documents of the first part, and how many times as many the next one ends at
RANGE_BITS = 33  # of a document's number, below the range of the order it stands in


def _grams(text: Column, size: int) -> Column:
    """Hashes of the substrings of a size, repeats included; one pass over the text."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), F.lit(1))
    return F.transform(found, lambda g: F.xxhash64(g))


def _beginning(n: int, gram: Column) -> Column:
    return F.left(gram, F.lit(n))


def _with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` (part, at, text) with ``grams``, the hashes of the text's distinct substrings. Only the
    longest are cut from the text; a shorter one begins a longer one or ends the text."""
    found = F.regexp_extract_all("text", F.lit(f"(?s)(?=({'.' * SIZE}))"), F.lit(1))
    rows = rows.withColumn(f"of_{SIZE}", F.array_distinct(found))
    for n in range(SIZE - 1, 0, -1):
        begins = F.transform(f"of_{n + 1}", partial(_beginning, n))
        last = F.when(F.length("text") >= n, F.array(F.right("text", F.lit(n))))
        ends = F.coalesce(last, F.array().cast("array<string>"))
        rows = rows.withColumn(f"of_{n}", F.array_distinct(F.concat(begins, ends)))
    grams = F.concat(*[F.transform(f"of_{n}", lambda g: F.xxhash64(g)) for n in range(1, SIZE + 1)])
    return rows.select("part", "at", grams.alias("grams"))


def _part_ends(rows: DataFrame) -> list[int]:
    """The numbers ``at`` of the last documents of all parts but the last."""
    sizes = rows.groupBy(F.shiftright("at", RANGE_BITS).alias("range")).agg(F.count("*").alias("n"))
    sizes = sorted(sizes.collect())  # as many rows as the texts' shuffle has partitions
    ends, before, end = [], 0, FIRST
    for range_, n in sizes:
        while end <= before + n:
            ends.append((range_ << RANGE_BITS) + end - before - 1)
            end *= GROWTH
        before += n
    return ends


@dataclass(frozen=True)
class SubstringIndex:
    """``documents`` (part, at, doc_id, text lower-cased), ``postings`` (part, gram, block, documents: a
    bit for each of the 64 from ``64 * block`` on), ``frequencies`` (gram, documents); all staged. And the
    number of parts."""

    documents: DataFrame
    postings: DataFrame
    frequencies: DataFrame
    parts: int


def build_index(corpus: DataFrame, order: Sequence[str | Column] = ("doc_id",)) -> SubstringIndex:
    """The index of ``corpus`` (doc_id, text), its documents numbered along ``order``.

    Ids are unique, and so is the order; null texts hold nothing. The driver learns how many documents
    each range of the order has.
    """
    rows = corpus.where(F.col("text").isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.monotonically_increasing_id().alias("at"), "doc_id", F.lower("text").alias("text"))
    rows, _ = stage(rows, "indexed-texts")
    ends, part = _part_ends(rows), F.lit(0)
    for end in ends:
        part = part + (F.col("at") > end).cast("int")
    rows = rows.withColumn("part", part)
    each = _with_grams(rows).select("part", "at", F.explode("grams").alias("gram"))
    each = each.select("part", "gram", F.shiftright("at", 6).alias("block"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
    postings = each.groupBy("part", "gram", "block").agg(F.bit_or("bit").alias("documents"))
    postings, _ = stage(postings.sortWithinPartitions("part", "gram"), "postings")
    counts = postings.groupBy("gram").agg(F.sum(F.bit_count("documents")).alias("documents"))
    frequencies, _ = stage(counts, "gram-frequencies")
    return SubstringIndex(rows, postings, frequencies, len(ends) + 1)


def _rarest_grams(index: SubstringIndex, tokens: DataFrame) -> DataFrame:
    """(token, gram, wanted): of every token that can occur, its rarest substrings and their number."""
    size = F.least(F.length("token"), F.lit(SIZE))
    grams = F.array()
    for n in range(SIZE, 0, -1):
        grams = F.when(size == n, _grams(F.col("token"), n)).otherwise(grams.cast("array<bigint>"))
    asked = tokens.select("token", F.array_distinct(grams).alias("grams"))
    asked = asked.select("token", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    known = asked.join(index.frequencies, "gram")
    own = Window.partitionBy("token")
    known = known.withColumn("found", F.count("*").over(own)).where("found = n")
    rank = F.row_number().over(own.orderBy("documents", "gram"))
    return known.withColumn("r", rank).where(F.col("r") <= RAREST).select(
        "token", "gram", F.least("n", F.lit(RAREST)).alias("wanted")
    )


@dataclass(frozen=True)
class Found:
    """``hits`` (query_id, doc_id, rank), and ``verified`` (token, part, documents): how many
    documents were searched for each token in each part of the order."""

    hits: DataFrame
    verified: DataFrame


def first_documents(index: SubstringIndex, queries: DataFrame, k: int = 5) -> Found:
    """The first ``k`` documents, in the index's order, that contain any token of the query's text as a
    substring, both lower-cased. ``queries`` (query_id, text)."""
    words = F.explode(F.array_distinct(keyword_tokens(F.col("text"))))
    tokens, _ = stage(queries.select("query_id", words.alias("token")), "query-tokens")
    grams, _ = stage(_rarest_grams(index, tokens.select("token").distinct()), "token-grams")
    matches, verified, open_ = [], [], grams
    for part in range(index.parts):
        postings = index.postings.where(F.col("part") == part).select("gram", "block", "documents")
        shared = open_.join(postings, "gram").groupBy("token", "block", "wanted").agg(
            F.count("*").alias("n"), F.bit_and("documents").alias("documents")
        )
        bits = F.expr("filter(sequence(0, 63), i -> getbit(documents, i) = 1)")
        candidates = shared.where("n = wanted and documents <> 0").select("token", "block", F.explode(bits).alias("bit"))
        candidates = candidates.select("token", (F.shiftleft("block", 6) + F.col("bit")).alias("at"))
        candidates, _ = stage(candidates, "candidates")  # few are broadcast, so that no text is shuffled
        texts = index.documents.where(F.col("part") == part).select("at", "doc_id", "text")
        searched = candidates.join(texts, "at").select("token", "at", "doc_id", F.contains("text", "token").alias("holds"))
        searched, _ = stage(searched, "searched")
        matches.append(searched.where("holds").select("token", "at", "doc_id"))
        counts = searched.groupBy("token").agg(F.count("*").alias("documents"))
        verified.append(counts.select("token", F.lit(part).alias("part"), "documents"))
        so_far = matches[0]
        for more in matches[1:]:
            so_far = so_far.union(more)
        full = so_far.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        open_ = grams.join(full, "token", "left_anti")
    first = Window.partitionBy("token").orderBy("at")
    so_far = so_far.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    own = tokens.join(so_far, "token").select("query_id", "at", "doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    hits = own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    told = verified[0]
    for more in verified[1:]:
        told = told.union(more)
    return Found(hits, told)

"""The substring index against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from textprep_spark.operators import substring_index as S


def plain_first(queries, texts, k, key):
    hits = set()
    for q, text in queries.items():
        words = (text or "").lower().split()
        found = [d for d, t in sorted(texts, key=key) if t is not None and any(w in t.lower() for w in words)][:k]
        hits |= {(q, d, i) for i, d in enumerate(found, 1)}
    return hits


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(4)
    words = ["".join(chance.choices("abcdeé日", k=chance.randint(1, 6))) for _ in range(80)]
    out = [(i, " ".join(chance.choices(words, k=chance.randint(0, 25))).title()) for i in range(900)]
    return out + [(2000, None), (2001, ""), (2002, "x" * 10_000 + "Needle"), (2003, "a.b|c(d)\ne\\f$")]


QUERIES = {1: "aba  zzzz", 2: "CAB é", 3: "zzzz", 4: " \t", 5: "b", 6: "needle", 7: "日", 8: None, 9: "a.b (d) \\f$", 10: "xxxxxxxx", 11: "ab bc ca"}


def frames(spark, texts):
    q = spark.createDataFrame(list(QUERIES.items()), "query_id int, text string")
    c = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id int, text string, gram string, at int")
    return q, c.repartition(5)


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_as_a_plain_scan(spark, texts, k):
    q, c = frames(spark, texts)
    found = S.first_documents(S.build_index(c), q, k)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.hits.collect()} == plain_first(QUERIES, texts, k, lambda d: d[0])


def test_another_order(spark, texts):
    q, c = frames(spark, texts)
    found = S.first_documents(S.build_index(c, [F.col("doc_id") % 7, F.col("doc_id").desc()]), q, 4)
    want = plain_first(QUERIES, texts, 4, lambda d: (d[0] % 7, -d[0]))
    assert {(r.query_id, r.doc_id, r["rank"]) for r in found.hits.collect()} == want


def test_few_documents_are_searched(spark, texts):
    q, c = frames(spark, texts)
    found = S.first_documents(S.build_index(c), q, 5)
    searched = {}
    for r in found.verified.collect():
        searched[r.token, r.part] = r.documents
    assert sum(n for (t, _), n in searched.items() if t == "needle") == 1
    assert ("zzzz", 0) not in searched
    # common tokens are done with the first parts
    assert all((t, 2) not in searched for t in ("b",)) and searched["b", 0] < 30


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a")], "query_id int, text string")
    assert S.first_documents(S.build_index(none), q).hits.collect() == []
    assert S.first_documents(S.build_index(none), q.limit(0)).hits.collect() == []


def test_file_positions(spark, tmp_path):
    """Files hold rows in no order of ids; positions follow path and row, after any shuffle."""
    from textprep_spark.operators.dedup import deduplicate
    from textprep_spark.sources.readers import with_file_position

    for part, ids in (("a", [5, 9, 1]), ("b", [8, 2]), ("c", [7, 3])):
        rows = [(i, "needle" if i != 9 else "hay") for i in ids]
        spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/{part}")
    df = with_file_position(spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path)))
    assert [r.doc_id for r in df.repartition(3).orderBy("position").collect()] == [5, 9, 1, 8, 2, 7, 3]
    assert sorted(r.doc_id for r in deduplicate(df, ["text"], ["position"]).collect()) == [5, 9]
    q = spark.createDataFrame([(1, "needle")], "query_id int, text string")
    hits = S.first_documents(S.build_index(df.repartition(3), ["position"]), q, 3).hits
    assert [r.doc_id for r in hits.orderBy("rank").collect()] == [5, 1, 8]


@pytest.mark.parametrize("order", ["doc_id", "at"])
def test_cost_of_a_common_token_and_of_postings(spark, order):
    """What a common token costs does not grow with the corpus, and postings do not list every document."""
    q = spark.createDataFrame([(1, "common")], "query_id int, text string")
    searched, postings = [], []
    for n in (1000, 8000):
        c = spark.range(n).selectExpr("id doc_id", f"{n} - id at", "concat('a common text ', id % 7, ' 😀日é') text")
        index = S.build_index(c, [order])
        found = S.first_documents(index, q, 5)
        first = range(5) if order == "doc_id" else range(n - 1, n - 6, -1)
        assert [r.doc_id for r in found.hits.orderBy("rank").collect()] == list(first)
        searched.append(sum(r.documents for r in found.verified.collect()))
        postings.append(index.postings.count() / index.frequencies.agg(F.sum("documents")).first()[0])
    assert searched[0] == searched[1] < 20
    assert max(postings) < 0.2

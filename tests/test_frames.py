"""Whole-frame operators: reading, writing, duplicates, splitting, enrichment, counting."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions.text import DEFAULT_LANGUAGES, LanguageConfig
from textprep_spark.operators.dedup import deduplicate
from textprep_spark.operators.enrich import enrich, tags_per_record
from textprep_spark.operators.normalize import apply_and_count, change_report, normalize_columns
from textprep_spark.operators.split import assign_split, split_frames, split_sizes
from textprep_spark.sources import readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- reading and writing ------------------------------------------------------------------------------


def test_read_records(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "col1 int, col2 string")
    df.coalesce(1).write.parquet(one + "/a.parquet")
    assert rows(readers.read_records(spark, one)) == [(1, "a"), (2, "b"), (3, "c")]

    df.coalesce(1).write.parquet(two + "/a.parquet")
    df.select(F.lit("z").alias("col3"), "col2").limit(1).write.parquet(two + "/b.parquet")
    both = readers.read_records(spark, two).select("col1", "col2", "col3")
    assert rows(both) == [(1, "a", None), (2, "b", None), (3, "c", None), (None, "a", "z")]
    narrow = readers.read_records(spark, two, both.select("col2").schema)
    assert narrow.columns == ["col2"] and narrow.count() == 4


def test_read_records_finds_nothing(spark, tmp_path):
    (tmp_path / "note.txt").write_text("x")
    for place in (tmp_path, tmp_path / "absent"):
        with pytest.raises(ValueError, match="No parquet files found"):
            readers.read_records(spark, str(place))


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([("y", 2.0)], "t string, d double")
    assert rows(readers.union_by_name([a, b])) == [(1, "x", None), (None, "y", 2.0)]


def test_write_datasets(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "i int, t string")
    b = spark.createDataFrame([(2, "y")], "i int, t string")
    out = str(tmp_path / "deep" / "down")
    writers.write_datasets([a, b], ["a.parquet", "b.parquet"], out)
    assert rows(spark.read.parquet(out + "/a.parquet")) == [(1, "x")]
    assert rows(spark.read.parquet(out + "/b.parquet")) == [(2, "y")]
    other = str(tmp_path / "other")
    with pytest.raises(ValueError):
        writers.write_datasets([a, b], ["a.parquet"], other)
    assert not os.path.exists(other)


def test_label_csv(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_bytes('query,query-fr,doc_id\n"a, ""b""",forêt,r1\n"two\nlines",eau,\nx,y,NA\n'.encode("latin-1"))
    got = rows(readers.read_label_queries(spark, str(path)))
    assert got == sorted([('a, "b"', "forêt", "r1"), ("two\nlines", "eau", None), ("x", "y", None)], key=repr)


def test_listed_csv(spark, tmp_path):
    path = tmp_path / "listed.csv"
    path.write_text("query,related_documents\nq1,\"['a', 'b']\"\nq2,\"[\"\"c\"\"]\"\nq3,\n")
    got = rows(readers.read_listed_queries(spark, str(path)))
    assert got == [("q1", ["a", "b"]), ("q2", ["c"]), ("q3", None)]
    path.write_text("query,related_documents\nq3,__import__('os')\n")
    with pytest.raises(Exception, match="not a list: __import__"):
        readers.read_listed_queries(spark, str(path)).collect()


def test_embeddings_csv(spark, tmp_path):
    path = tmp_path / "vectors.csv"
    path.write_text('doc_id,embedding\nd1,"[0.5, 1]"\nd2,"[2, -1e-3]"\n')
    assert rows(readers.read_embeddings_csv(spark, str(path))) == [("d1", [0.5, 1.0]), ("d2", [2.0, -0.001])]
    df = spark.createDataFrame([(1, [1.0])], "k int, v array<float>")
    assert rows(readers.embedding_source(df, "k", "v")) == [(1, [1.0])]


def test_lookup_export(spark, tmp_path):
    path = tmp_path / "lookup.json"
    items = [{"uuid": {"S": "u1"}, "loc": {"S": "foundational"}, "more": {"N": "1"}}, {"uuid": {"S": "u2"}, "loc": {"S": "x"}}]
    path.write_text("\n".join(map(json.dumps, items)))
    assert rows(readers.read_lookup(spark, str(path), "loc")) == [("u1", "foundational"), ("u2", "x")]
    plain = spark.createDataFrame([("u", "t")], "uuid string, tag string")
    assert rows(readers.lookup_table(plain)) == [("u", "t")]


def test_predictions_and_routes(spark, tmp_path):
    df = spark.createDataFrame([("d1", ["a", 'b"c'])], "doc_id string, top_ids array<string>")
    path = writers.write_predictions(df, str(tmp_path), "some/model-x")
    assert path.endswith("model-x")
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert back["doc_id"] == "d1" and json.loads(back["top_ids"]) == ["a", 'b"c']
    assert writers.output_directory("out/", False) == "out"
    assert writers.output_directory("out/", True) == "out/with_eocollections"


def test_staging_is_removed(spark):
    with writers.staged(spark.range(5).toDF("i"), "numbers") as table:
        path = table.inputFiles()[0].removeprefix("file://")
        assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and os.path.exists(path)
        assert table.count() == 5
    assert not os.path.exists(path)


# --- duplicates ---------------------------------------------------------------------------------------


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "col1 int, col2 string")
    assert rows(deduplicate(df, ["col1"], ["col2"])) == [(1, "a"), (2, "c"), (3, "d")]
    cross = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "col1 int, col2 string")
    assert rows(deduplicate(cross, ["col1", "col2"], ["col1", "col2"])) == [(1, "a")]
    nulls = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "col1 int, col2 string")
    assert rows(deduplicate(nulls, ["col1"], ["col2"])) == [(1, "a"), (None, "c")]
    texts = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "i int, t string")
    assert rows(deduplicate(texts, ["t"], ["i"])) == [(1, None), (3, "x")]
    assert deduplicate(df.where("false"), ["col1"], ["col2"]).count() == 0
    assert deduplicate(df, ["col2"], ["col1"]).count() == 4


def test_deduplicate_is_stable_and_idempotent(spark):
    base = spark.range(3000).select(
        (F.col("id") % 700).cast("string").alias("t"),
        F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("u"),
        (F.col("id") % 50).alias("k"),
        "id",
    )
    once = rows(deduplicate(base, ["t", "u"], ["k"]))
    assert once == rows(deduplicate(base.repartition(13, "u"), ["t", "u"], ["k"]))
    again = spark.createDataFrame(once, base.schema)
    assert rows(deduplicate(again, ["t", "u"], ["k"])) == once
    seen, kept = set(), []  # first pass by hand: smallest k per t, ties by row hash
    firsts = {}
    for r in base.withColumn("h", F.xxhash64("t", "u", "k", "id")).collect():
        key = (r["k"], r["h"])
        if r["t"] not in firsts or key < firsts[r["t"]][0]:
            firsts[r["t"]] = (key, r)
    for _, (key, r) in sorted(firsts.items(), key=lambda x: x[1][0]):
        if r["u"] not in seen:
            seen.add(r["u"])
            kept.append((r["t"], r["u"], r["k"], r["id"]))
    assert once == sorted(kept, key=repr)


def test_hot_value_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("hot").alias("t"), "id")
    plan = deduplicate(df, ["t"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --- splitting ------------------------------------------------------------------------------------------


def sizes(assigned):
    return dict(Counter(r["split"] for r in assigned.select("split").collect()))


def test_split_ten_rows(spark):
    df = spark.createDataFrame([(i, "same") for i in range(10)], "col1 int, col2 string")
    assigned = assign_split(df, 0.4, 7)
    assert sizes(assigned) == {"train": 6, "eval": 2, "test": 2}
    parts = split_frames(assigned)
    assert [p.count() for p in parts] == [6, 2, 2]
    assert sorted(r[0] for p in parts for r in p.collect()) == list(range(10))
    assert rows(assigned) == rows(assign_split(df.repartition(5), 0.4, 7))
    assert rows(assigned) != rows(assign_split(df, 0.4, 8))


@pytest.mark.parametrize("n, holdout", [(0, 0.1), (1, 0.5), (2, 0.5), (17, 0.1), (9999, 0.1), (20000, 0.37), (50, 1.0), (50, 0.0), (50, 7)])
def test_split_is_exact(spark, n, holdout):
    want = split_sizes(n, holdout)
    got = sizes(assign_split(spark.range(n), holdout, 42))
    assert got.get("test", 0) == want.test
    assert got.get("eval", 0) == want.eval
    assert got.get("train", 0) == want.train == n - want.test - want.eval


def test_split_equals_global_order(spark):
    import hashlib

    df = spark.range(5000)
    order = sorted(range(5000), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    got = {r["id"]: r["split"] for r in assign_split(df, 0.1, 42).collect()}
    assert [got[i] for i in order] == ["test"] * 250 + ["eval"] * 250 + ["train"] * 4500


def test_split_of_identical_rows(spark, tmp_path):
    path = str(tmp_path / "copies")
    spark.range(900).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("i")).write.parquet(path)
    table = spark.read.parquet(path)
    position = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    for holdout in (0.1, 0.35, 0.6, 0.9):
        want = split_sizes(900, holdout)
        got = sizes(assign_split(table, holdout, 42, tie_break=position))
        assert (got["test"], got["eval"], got["train"]) == (want.test, want.eval, want.train)
    for holdout in (0.1, 0.3, 0.5, 0.7, 0.9):
        want = split_sizes(300, holdout)
        got = sizes(assign_split(table.where("i = -1"), holdout, 42))
        assert [got.get(k, 0) for k in ("test", "eval", "train")] == [want.test, want.eval, want.train]


def test_split_of_twenty_equal_rows(spark):
    got = sizes(assign_split(spark.range(20).select(F.lit("x").alias("i")), 0.4, 42))
    assert (got["train"], got["eval"], got["test"]) == (12, 4, 4)


def test_split_arguments():
    with pytest.raises(ValueError):
        split_sizes(10, 1.5)
    with pytest.raises(ValueError):
        split_sizes(10, 11)


# --- enrichment -------------------------------------------------------------------------------------------


@pytest.fixture
def themed(spark):
    rows_ = [("r1", ["economy"]), ("r2", ["legal"]), ("r3", [])]
    return spark.createDataFrame(rows_, f"{fv.ID} string, {fv.P}geo_theme array<string>")


def lookup(spark, pairs):
    return spark.createDataFrame(pairs, "uuid string, tag string")


def test_enrich(spark, themed):
    theme = lookup(spark, [("r1", "legal"), ("r1", "emergency"), ("r1", "legal"), ("r2", "legal"), ("r3", "other"), ("r9", "legal"), (None, "legal"), ("r3", None)])
    base = lookup(spark, [("r1", "foundational"), ("r3", "other"), ("r3", "")])
    out = enrich(themed, [(theme, ["emergency", "legal"]), (base, None)])
    assert out.columns == themed.columns
    assert rows(out) == [
        ("r1", ["economy", "emergency", "legal", "foundational"]),
        ("r2", ["legal"]),
        ("r3", ["other"]),
    ]


def test_enrich_with_nothing(spark, themed):
    assert rows(enrich(themed, [])) == rows(themed)
    assert rows(enrich(themed, [(lookup(spark, []), None)])) == rows(themed)


def test_enrichment_join_can_be_chosen(spark, themed):
    tags = lookup(spark, [("r1", "a")] * 50)
    for hint, join in (("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")):
        out = enrich(themed, [(tags, None)], join_hint=hint)
        assert join in out._jdf.queryExecution().executedPlan().toString()
        assert rows(out)[0] == ("r1", ["economy", "a"])


def test_malformed_text_is_an_error(spark):
    bad = spark.createDataFrame([(1, "[0.1 0.2]"), (2, None)], "k int, v string")
    with pytest.raises(Exception, match="not a vector: "):
        readers.embedding_source(bad, "k", "v").collect()
    with pytest.raises(Exception, match="not a list: "):
        bad.select(readers.text_list(F.col("v"))).collect()


# --- counting changes -----------------------------------------------------------------------------------


def test_change_report(spark):
    df = spark.createDataFrame([("a@b.org  x!!",), ("clean",), (None,), ("y References z",)], "t string")
    report = {r["step"]: (r["changed_rows"], r["null_rows"]) for r in change_report(df, "t", DEFAULT_LANGUAGES["en"]).collect()}
    assert report["cut_section"] == (1, 1)
    assert report["mask_emails"] == (1, 1)
    assert report["mask_urls"] == (0, 1)
    assert report["collapse_punctuation"] == (1, 1)
    assert report["squeeze_whitespace"] == (1, 1)


def test_counts_in_passing(spark):
    df = spark.createDataFrame([("a@b.org  x!!",), ("clean",), (None,)], "d_en string")
    seen = Observation("changes")
    languages = {"en": LanguageConfig(None, [("°", " deg ")])}
    counted = normalize_columns(df, ["d_en"], languages, seen)
    assert rows(counted) == rows(normalize_columns(df, ["d_en"], languages))
    assert counted.columns == ["d_en", "d_normalized_en"]
    assert seen.get["d_normalized_en.mask_emails"] == 1
    assert seen.get["d_normalized_en.mask_urls"] == 0
    assert seen.get["d_normalized_en.nulls"] == 1


def test_apply_and_count(spark):
    df = spark.createDataFrame([("keep",), ("swap me",), (None,)], "t string")
    seen = Observation("swap")

    def swap(c, old, new):
        return F.replace(c, F.lit(old), F.lit(new))

    out = apply_and_count(df, "t", swap, seen, old="me", new="you")
    assert [r[0] for r in out.collect()] == ["keep", "swap you", None]
    assert seen.get == {"changed_rows": 1, "null_rows": 1}


def test_opaque_functions_run_as_pandas_udf(spark):
    import pandas as pd

    @F.pandas_udf("string")
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper()

    df = spark.createDataFrame([("a",), ("B",)], "t string")
    seen = Observation("shout")
    assert [r[0] for r in apply_and_count(df, "t", shout, seen).collect()] == ["A", "B"]
    assert seen.get["changed_rows"] == 1

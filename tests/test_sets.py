"""Sets written in one pass, and splits whose boundary falls among rows of one key."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep_spark.operators import split
from textprep_spark.sources import writers

NAMES = {"train": "train.parquet", "test": "test.parquet"}


def files_of(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def test_sets_in_one_pass(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "if(id < 90, 'train', 'test') as split", "'x' as note")
    writers.write_sets(df, NAMES, str(tmp_path))
    sets = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("train", "test")}
    assert {n: (s.count(), s.columns) for n, s in sets.items()} == {"train": (90, ["id", "note"]), "test": (10, ["id", "note"])}
    assert {p.name for p in tmp_path.iterdir()} == {"train.parquet", "test.parquet"}
    writers.write_sets(df.where("id >= 50").withColumn("split", F.lit("train")), NAMES, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/train.parquet").count() == 50
    assert spark.read.parquet(f"{tmp_path}/test.parquet").collect() == []


@pytest.mark.parametrize("wrong", ["'other'", "cast(null as string)"])
def test_a_failed_write_leaves_what_was_there(spark, tmp_path, wrong):
    df = spark.range(20).selectExpr("id", "'train' as split")
    writers.write_sets(df, NAMES, str(tmp_path))
    before = files_of(tmp_path)
    with pytest.raises(PySparkException):
        writers.write_sets(df.withColumn("split", F.expr(f"if(id = 7, {wrong}, split)")), NAMES, str(tmp_path))
    assert files_of(tmp_path) == before and spark.read.parquet(f"{tmp_path}/train.parquet").count() == 20


def test_the_input_is_read_once_for_the_write(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "in"))
    rows = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "in")).mapInArrow(count, "id long")
    df = df.selectExpr("id", "if(id % 3 = 0, 'test', 'train') as split")
    writers.write_sets(df, NAMES, str(tmp_path / "out"))
    assert rows.value == 1000


def test_rows_of_one_key_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(split, "COPIES", 50)
    monkeypatch.setattr(split, "SALTS", 16)
    equal = spark.range(5000).selectExpr("'k' as __split_key", "'same' as a", "cast(null as int) as b")
    other = spark.range(3000).selectExpr("if(id % 3 = 0, 'm', 'k') as __split_key", "concat('r', id) as a", "cast(id % 5 as int) as b")
    rows = equal.union(other).union(other.limit(10))
    got = split._numbered(rows, "__number")
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 4000  # the 5000 equal rows are in several places
    for key, n in (("k", 7000), ("m", 1000)):
        found = sorted(r[0] for r in got.where(F.col("__split_key") == key).select("__number").collect())
        assert found[:n] == list(range(1, n + 1)) and n <= len(found) <= n + 10 and found == list(range(1, len(found) + 1))
    assert got.drop("__number").exceptAll(rows).count() == rows.exceptAll(got.drop("__number")).count() == 0


@pytest.mark.parametrize("copies", [50, 100_000])
def test_exact_sizes_among_copies(spark, monkeypatch, copies):
    monkeypatch.setattr(split, "COPIES", copies)
    df = spark.range(1000).selectExpr("if(id < 800, 'en', 'fr') as lang", "if(id < 600, 0, id) as x", "map('a', 1) as m")
    for frame in (df, df.drop("m")):
        got = split.assign_split(frame, 0.1, 42, ["lang"]).groupBy("split").count().collect()
        assert {r.split: r["count"] for r in got} == {"train": 900, "eval": 50, "test": 50}


def test_folders_of_mixed_types(spark, tmp_path):
    """Keywords are text in one file and a list in another; numbers and missing columns differ, too."""
    from textprep_spark.sources.readers import file_schemas, read_mixed_records

    folder = str(tmp_path)
    parts = {
        "a": spark.createDataFrame([(1, "x, y", 1.5)], "id int, keywords string, size double"),
        "b": spark.createDataFrame([(2, ["p", "q"], 2), (3, None, None)], "id bigint, keywords array<string>, size int"),
        "c": spark.createDataFrame([("4", None)], "id string, extra string"),
        "d": spark.createDataFrame([(5, "z", 0.5)], "id int, keywords string, size double"),
    }
    for name, df in parts.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    groups = file_schemas(spark, folder)
    assert len(groups) == 3 and sorted(len(paths) for _, paths in groups) == [1, 1, 2]
    schema = "id bigint, keywords array<string>, size double"
    want = T.StructType.fromDDL(schema)
    got = read_mixed_records(spark, folder, want)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want]
    assert sorted(map(tuple, got.collect())) == [
        (1, ["x", "y"], 1.5), (2, ["p", "q"], 2.0), (3, None, None), (4, None, None), (5, ["z"], 0.5)
    ]
    text = read_mixed_records(spark, folder, T.StructType.fromDDL("keywords string"))
    assert sorted((r[0] or "") for r in text.collect()) == ["", "", "p, q", "x, y", "z"]
    with pytest.raises(ValueError, match="keywords"):
        read_mixed_records(spark, folder, T.StructType.fromDDL("keywords struct<a:int>"))
    with pytest.raises(ValueError, match="No parquet"):
        read_mixed_records(spark, folder + "/none", want)


def test_job_over_mixed_types(spark, tmp_path):
    """Keywords as lists in one file give the same sets as keywords as text in all."""
    from textprep_spark import fixed_values as fv
    from textprep_spark.catalog.records import records
    from textprep_spark.operators.cleaning import lists_from_text
    from textprep_spark.plans.jobs import PrepareTextConfig, run_prepare_text

    lists = [fv.P + "keywords_en", fv.P + "keywords_fr"]
    rows = records(spark, "/root/testdata/sf0.001").select(*fv.TEXT_COLUMNS).where(F.col(lists[0]).isNotNull() & F.col(lists[1]).isNotNull())
    half = F.crc32(F.col(fv.ID).cast("binary")) % 2 == 0
    rows.write.parquet(f"{tmp_path}/plain/all.parquet")
    rows.where(half).write.parquet(f"{tmp_path}/mixed/a.parquet")
    lists_from_text(rows.where(~half), lists).write.parquet(f"{tmp_path}/mixed/b.parquet")
    found = []
    for name in ("plain", "mixed"):
        target = run_prepare_text(spark, PrepareTextConfig(f"{tmp_path}/{name}", f"{tmp_path}/out-{name}", mixed=name == "mixed"))
        found.append({n: sorted(map(str, spark.read.parquet(f"{target}/{n}.parquet").collect())) for n in ("train", "eval", "test")})
    assert found[0] == found[1] and len(found[0]["train"]) > 50
    with pytest.raises(ValueError, match="eoCollection"):
        rows.drop(fv.P + "eoCollection").write.parquet(f"{tmp_path}/less/a.parquet")
        run_prepare_text(spark, PrepareTextConfig(f"{tmp_path}/less", f"{tmp_path}/out-less", mixed=True))

"""The preparation plans end to end, their physical plans, and every registered query."""

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as registered
from textprep_spark import fixed_values as fv
from textprep_spark.catalog.queries import CATALOG
from textprep_spark.catalog.records import foundational_lookup, records, theme_lookup
from textprep_spark.plans.jobs import PrepareTextConfig, parse_args, run_prepare_text
from textprep_spark.plans.prepare import prepare_full, prepare_text

SMALL = "/root/testdata/sf0.001"
P = fv.P


def record(i, title="T", body="b", eo=None, **more):
    row = {c: None for c in fv.TEXT_COLUMNS}
    row.update({fv.ID: f"r{i}", P + "title_en": title, P + "description_en": body, P + "eoCollection": eo})
    row.update({P + k: v for k, v in more.items()})
    return row


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in fv.TEXT_COLUMNS))


def test_prepare_text(spark):
    rows = [
        record(1, body="See www.x.org/a References all", title_fr="A", keywords_en="a ,b"),
        record(2, body="same", title_fr="B"),
        record(3, body="same", title_fr="C"),
        record(4, body="other", title_fr="B"),
        record(5, body=None, title=None),
    ]
    out = {r[fv.ID]: r for r in prepare_text(frame(spark, rows)).collect()}
    assert set(out) == {"r1", "r2", "r5"}  # r3 repeats r2 in English, r4 repeats r2 in French
    assert out["r1"]["text_en"] == "T\nkeywords:a, b\nSee x.org [url]"
    assert out["r1"]["text_fr"] == "A\nmots-clés associés:\n"
    assert out["r5"]["text_en"] == "\nkeywords:\n"
    assert list(out["r1"].asDict()) == [
        *fv.TEXT_COLUMNS,
        P + "description_normalized_en",
        P + "description_normalized_fr",
        "text_en",
        "text_fr",
        "text_seq",
        "text_para",
    ]


def test_eo_record_takes_its_copies_along(spark):
    rows = [record(1, eo="sentinel", title_fr="x"), record(2, title_fr="y"), record(3, body="z", title_fr="z")]
    assert [r[fv.ID] for r in prepare_text(frame(spark, rows)).collect()] == ["r3"]
    kept = prepare_text(frame(spark, rows), keep_eo=True)
    assert sorted(r[fv.ID] for r in kept.collect()) == ["r1", "r3"]


def test_equal_ids_do_not_depend_on_layout(spark):
    rows = [record(1, eo=None, title_fr="x"), record(1, eo="s", title_fr="x"), record(1, eo="t", title_fr="x")]
    a = prepare_text(frame(spark, rows), keep_eo=True).collect()
    b = prepare_text(frame(spark, rows[::-1]).repartition(3), keep_eo=True).collect()
    assert a == b and len(a) == 1


def test_missing_column(spark):
    with pytest.raises(ValueError, match="eoCollection"):
        prepare_text(frame(spark, [record(1)]).drop(P + "eoCollection"))


def test_counts_of_the_preparation(spark):
    seen = Observation("prepared")
    rows = [record(1, body="a@b.org"), record(2, body="x")]
    prepare_text(frame(spark, rows), observation=seen).collect()
    assert seen.get[P + "description_normalized_en.mask_emails"] == 1


def test_prepare_full_columns(spark):
    df = prepare_full(records(spark, SMALL), theme_lookup(spark, SMALL), foundational_lookup(spark, SMALL))
    assert P + "temporalExtent_begin" not in df.columns
    types = dict(df.dtypes)
    assert types["temporalExtent"] == "struct<begin:string,end:string>"
    assert types[P + "org"] == "struct<en:string,fr:string>"
    assert types[P + "type"] == "array<string>"
    assert types[P + "mappable"] == types[P + "foundational"] == "string"
    assert not [c for c in df.columns if c.startswith("__")]
    alone = prepare_full(records(spark, SMALL))
    assert alone.columns == df.columns and alone.count() == df.count()


def test_job(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    records(spark, SMALL).select(*fv.TEXT_COLUMNS).write.parquet(source + "/part.parquet")
    whole = prepare_text(spark.read.parquet(source + "/part.parquet"))
    assert run_prepare_text(spark, PrepareTextConfig(source, target)) == target
    sets = [spark.read.parquet(f"{target}/{n}.parquet") for n in ("train", "eval", "test")]
    n, counts = whole.count(), [s.count() for s in sets]
    held = -(-n // 10)
    assert counts == [n - held, held // 2, held - held // 2]
    assert sets[0].columns == whole.columns
    ids = sorted(r[0] for s in sets for r in s.select(fv.ID).collect())
    assert ids == sorted(r[0] for r in whole.select(fv.ID).collect())
    again = str(tmp_path / "again")
    run_prepare_text(spark, PrepareTextConfig(source, again))
    for name, s in zip(("train", "eval", "test"), sets):
        assert sorted(map(str, s.collect())) == sorted(map(str, spark.read.parquet(f"{again}/{name}.parquet").collect()))
    kept = run_prepare_text(spark, PrepareTextConfig(source, target, keep_eo=True))
    assert kept == target + "/with_eocollections"


def test_job_arguments():
    config = parse_args(["--input-dir", "a", "--output-dir", "b", "--keep-eo"])
    assert config == PrepareTextConfig("a", "b", 0.1, 42, True)


def test_physical_plan_of_the_preparation(spark):
    plan = prepare_text(records(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert plan.count("WindowGroupLimit") == 4
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    # each language's chain once, though five columns read its result
    assert plan.count("[url]") <= 2


def test_json_is_parsed_once(spark):
    df = prepare_full(records(spark, SMALL))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 3 or plan.count("parse_json") == 3


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr
    )


@pytest.mark.parametrize("name", [n for n, r in CATALOG.items() if r.sql])
def test_registered_query(spark, duck, name):
    df = CATALOG[name].run(spark, SMALL)
    got = comparable(df.columns, [tuple(r) for r in df.collect()])
    answer = duck.execute(CATALOG[name].sql)
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == comparable(columns, answer.fetchall())
    assert got


def test_every_query_is_registered_with_its_sql():
    assert set(CATALOG) <= set(registered.queries())
    sql = registered.oracle_sql()
    assert {n: r.sql for n, r in CATALOG.items() if r.sql} == {n: sql[n] for n in CATALOG if n in sql}


def test_entry(spark):
    assert registered.entry(spark).count() > 0

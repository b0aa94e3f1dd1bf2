"""Models get texts of like length together; results stay with their texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from textprep_spark.operators import infer


#: a model that tells the length of each text and of the longest in its batch
loader = lambda: lambda texts: np.array([[len(t or ""), max(len(x or "") for x in texts)] for t in texts], dtype=float)


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(2)
    return ["x" * chance.choice([1, 3, 40, 400, chance.randint(1, 900)]) for _ in range(3000)] + [None, ""]


def padding(rows):
    return sum(longest - own for own, longest in rows)


@pytest.mark.parametrize("arrow_rows", [10_000, 7])
def test_less_padding_in_the_same_order(spark, texts, arrow_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
        got = infer.embed_texts(df, "t", loader, batch_size=32).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.i for r in got) == list(range(len(texts)))
    assert all(r.embedding[0] == len(texts[r.i] or "") for r in got)
    unordered = sum(max(map(len, part)) * len(part) - sum(map(len, part)) for part in (
        [t or "" for t in texts[k : k + 32]] for k in range(0, len(texts), 32)))
    assert padding(r.embedding for r in got) < 0.05 * unordered


def test_the_buffer_is_bounded(monkeypatch):
    monkeypatch.setattr(infer, "BUFFER_TEXTS", 10)
    monkeypatch.setattr(infer, "BUFFER_CHARS", 100)
    stream = [pa.array(["a"] * 25), pa.array(["b" * 60, "c" * 60, None, "d"]), pa.array([], pa.string())]
    runs = list(infer._buffers(iter(stream)))
    assert [t for run in runs for t in run] == [t for batch in stream for t in batch.to_pylist()]
    assert max(map(len, runs)) <= 10 and all(sum(len(t or "") for t in run[:-1]) < 100 for run in runs)


def test_a_result_for_every_text(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    with pytest.raises(Exception, match="1 results for 2 texts"):
        infer.embed_texts(df.coalesce(1), "t", lambda: lambda texts: np.ones((1, 1))).collect()

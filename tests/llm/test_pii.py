import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import pii_spans
from textprep_spark.llm import catalog, pii

SMALL = "/root/testdata/sf0.01"

TEXTS = [
    None,
    "",
    "a@b.c_x@d.e f@g.h",
    "x@y a@b.c@d.e ..%+-@a.b.c-",
    "1.2.3.4.5.6.7.8 999.1.1.1.5 0000.00255.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111111",
    "41111111 11111111 4111 1111  1111 1111 00000000000000",
    "call +1 (073) 555-8658 or +49 30 1234567890123456 +1 2 3",
    "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE88370400440532013000",
    'tökén token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 04dbebab91ab85687d33eeaaf9ac699e',
    "é😀 mail é a.b@c.de 😀 10.0.0.1",
    "+" * 50 + "1" * 50,
]


HEX = [f"{i}4dbebab91ab85687d33eeaaf9ac699e" for i in range(12)]
TEXTS += [
    "api keys: " + ", ".join(HEX[:3]),
    HEX[0] + " is my password",
    "the token that we were given for this machine is: " + HEX[0],
    "keys: " + " ".join(HEX) + " tokens",
    "token" + "x" * 252 + " " + HEX[0] + "; toke" + "\n" * 260 + HEX[1],
    "token " + "-" * 249 + HEX[0] + "é" * 256 + "token",
]


def check(rows):
    for r in rows:
        spans = pii_spans(r.text)
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans if k in pii.BASE)
        assert r.told == told, r.text
        assert r.base == base


def found(df):
    spans = pii.find_spans(df)
    both = spans.select(
        "text",
        pii.joined(F.col("spans")).alias("told"),
        pii.joined(pii.of_kind(F.col("spans"), *pii.BASE)).alias("base"),
    )
    return both.collect()


def test_cases(spark):
    df = spark.createDataFrame([(t, 1) for t in TEXTS + TEXTS[3:5]], "text string, kind int")
    rows = found(df)
    assert len(rows) == len(TEXTS) + 2
    check(rows)


def test_random_texts(spark):
    import random

    chance = random.Random(4)
    parts = ["1", "23", "4111", ".", " ", "-", "+", "@", "a", "é", "(", ")", "255", "_", "\n", "AB"]
    texts = ["".join(chance.choices(parts, k=chance.randint(1, 40))) for _ in range(3000)]
    check(found(spark.createDataFrame([(t,) for t in texts], "text string")))


@pytest.mark.parametrize(
    "text", ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "a.@" * 100_000, "1." * 150_000, "+1(" * 99_999]
)
def test_hostile_texts_take_linear_time(spark, text):
    start = time.time()
    found(spark.createDataFrame([(text,)], "text string"))
    assert time.time() - start < 20


def test_whole_table(spark):
    rows = {r.doc_id: r for r in catalog.CATALOG["op4_pii"].run(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = pii_spans(d.text)
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans if k in pii.BASE)
        r = rows[d.doc_id]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        for kind in pii.BASE:
            assert r[f"n_{kind}"] == sum(k == kind for _, _, _, k in spans)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "text string")) == []


def test_secrets_share_the_context_of_a_list(spark):
    rows = [("api keys: " + ", ".join(HEX[:3]), 3), (HEX[0] + " is my password", 1), ("a " + HEX[0], 0)]
    got = pii.find_spans(spark.createDataFrame(rows, "text string, n int"))
    assert all(r.n == sum(s.kind == "secret" for s in r.spans) for r in got.collect())


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a@b.c", "own", "kept", 1)], "text string, __hits0 string, spans string, __gaps5 int")
    got = pii.find_spans(df)
    assert got.columns == [*df.columns, "spans_"]
    row = got.first()
    assert row[:4] == ("a@b.c", "own", "kept", 1) and [s.kind for s in row[4]] == ["email"]

"""Registered queries against their SQL, and the pipeline against what its stages promise."""

import base64
import sys
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

from tests.conftest import ROOT
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_near_dedup import brute as plain_near
from textprep_spark.llm import catalog, mixing, quality_rules
from textprep_spark.llm.common import stage, table

SMALL = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n, r in catalog.CATALOG.items() if r.sql])
def test_query_and_sql_agree(spark, duck, name):
    df = catalog.CATALOG[name].run(spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(catalog.CATALOG[name].sql)
    order = {d[0]: i for i, d in enumerate(answer.description)}
    assert sorted(order) == columns
    assert got == sorted((tuple(r[order[c]] for c in columns) for r in answer.fetchall()), key=repr)


def test_every_operator_is_registered():
    numbers = [n.split("_")[0] for n in catalog.CATALOG]
    assert sorted(numbers) == sorted(f"op{i}" for i in range(1, 14))


def test_pipeline(spark):
    sys.path.insert(0, ROOT)
    import corpus_pipeline

    docs, made = table(spark, TINY, "documents"), []
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, TINY), "stage")
        made.append(docs)
    whole, sound, lined, single, mixed, encoded = table(spark, TINY, "documents"), *made
    assert all(df.columns == whole.columns for df in made[:-1])
    assert sound.join(whole, sound.columns, "left_anti").count() == 0 and 0 < sound.count() < whole.count()
    assert lined.count() == sound.count()
    rejected = whole.join(sound, "doc_id", "left_anti")
    rules = quality_rules.fit(whole, table(spark, TINY, "labels"))
    judged = {r.doc_id: r.kept for r in quality_rules.apply_rules(whole, rules).collect()}
    assert not any(judged[r.doc_id] for r in rejected.collect()) and all(judged[r.doc_id] for r in sound.collect())
    # every later stage against its plain version, on all rows of its own input
    texts = {r.doc_id: r.text for r in lined.collect()}
    assert texts == plain_lines([(r.doc_id, r.text) for r in sound.collect()])
    stays = {i for i, _, c in plain_near(list(texts.items())) if i == c}
    assert {r.doc_id: r.text for r in single.collect()} == {i: texts[i] for i in stays}
    words = {r.doc_id: r.size for r in single.select("doc_id", mixing.word_count(single.text).alias("size")).collect()}
    taken = sum(words[r.doc_id] for r in mixed.collect())
    assert abs(taken / (1.5 * sum(words.values())) - 1) < 0.02
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= stays and max(copies.values()) <= 2
    assert all(r.text == texts[r.doc_id] for r in mixed.collect())
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = encoded.collect()
    assert Counter(r.doc_id for r in tokens) == copies and all(r.intact for r in tokens)
    assert all(r.ids == plain.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in tokens)
    assert corpus_pipeline.run(spark, TINY).count() == encoded.count()

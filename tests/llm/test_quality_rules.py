import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprep_spark.llm import catalog, quality_rules as q

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {
        k
        for i in range(len(words) - 2)
        if windows[tuple(words[i : i + 3])] > 1
        for k in (i, i + 1, i + 2)
    }
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_counts_of_random_texts():
    chance = random.Random(1)
    parts = ["a", "b", "é", "😀", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "#", "|", "A", "1", "!"]
    for _ in range(3000):
        text = "".join(chance.choices(parts, k=chance.randint(0, 60)))
        assert q.count_text(text.encode())[:5] == brute(text)


def test_whole_table(spark):
    rows = {r.doc_id: r for r in catalog.CATALOG["op1_quality_rules"].run(spark, SMALL).collect()}
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(documents)
    for d in documents:
        r, want = rows[d.doc_id], brute(d.text)
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed and r.rule is None)


def test_labelled_good_documents_stay(spark):
    rows = catalog.CATALOG["op1_quality_rules"].run(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    both = rows.join(labels, "doc_id").where("not base_failed")
    shares = {r.quality: r.kept for r in both.groupBy("quality").agg(F.avg(F.expr("int(kept)")).alias("kept")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.2


def test_learns_a_conjunction_and_emits_it(spark):
    chance = np.random.default_rng(0)
    x = chance.uniform(size=(3000, 3))
    bad = (x[:, 0] >= 0.6) & (x[:, 1] <= 0.3)
    rules = q.learn_rules(x, bad, np.arange(3000) % 3 == 0, ["a", "b", "c"])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    found = [r[0] is not None for r in df.select(rules.first_match({c: F.col(c) for c in "abc"})).collect()]
    assert np.mean(np.array(found) == bad) > 0.97
    assert "a >=" in str(rules) and "b <=" in str(rules)


def test_null_statistics_satisfy_no_rule(spark):
    rules = q.DecisionList(((q.Condition("a", False, 1.0),),))
    df = spark.createDataFrame([(None,), (0.5,), (2.0,)], "a double")
    assert [r[0] for r in df.select(rules.first_match({"a": F.col("a")})).collect()] == [None, 1, None]


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 0), (9, 0)]])
def test_odd_tables(spark, labels):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "x"), (1, text, "x"), (2, None, None), (3, "", "y"), (None, text, "z"), (4, "a " * 400_000, "z")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int")
    judged = q.apply_rules(documents, q.fit(documents, rated)).collect()
    kept = sorted((str(r.doc_id), r.kept) for r in judged)
    assert kept == [("1", True), ("1", True), ("2", False), ("3", False), ("4", False), ("None", True)]
    none = documents.limit(0)
    assert q.apply_rules(none, q.fit(none, rated)).collect() == []

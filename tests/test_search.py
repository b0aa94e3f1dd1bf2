"""Search, metrics, pairs and inference against brute force on small fixtures."""

import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from textprep_spark.functions import vectors as V
from textprep_spark.operators import metrics as M
from textprep_spark.operators.infer import embed_texts, generate_questions
from textprep_spark.operators.pairs import adjacent_pairs, text_halves
from textprep_spark.operators.search import DISTANCES, keyword_first, top_k
from textprep_spark.plans.evaluate import evaluate_search, search
from textprep_spark.plans.evaluate import main as evaluate_main

RNG = np.random.default_rng(5)
DIM = 6


def cosine(q, c):
    n = np.linalg.norm(q) * np.linalg.norm(c)
    return None if n == 0 else float(q @ c / n)


BRUTE = {
    "cosine": cosine,
    "correlation": lambda q, c: cosine(q - q.mean(), c - c.mean()),
    "euclidean": lambda q, c: 1 - float(np.linalg.norm(q - c)),
    "sqeuclidean": lambda q, c: 1 - float(np.sum((q - c) ** 2)),
    "cityblock": lambda q, c: 1 - float(np.sum(np.abs(q - c))),
    "chebyshev": lambda q, c: 1 - float(np.max(np.abs(q - c))),
    "canberra": lambda q, c: 1 - float(sum(abs(a - b) / (abs(a) + abs(b)) if abs(a) + abs(b) else 0 for a, b in zip(q, c))),
    "braycurtis": lambda q, c: 1 - float(np.sum(np.abs(q - c)) / np.sum(np.abs(q + c))),
}


@pytest.fixture(scope="module")
def data():
    """A third of the corpus is one vector: ties everywhere, so ids decide."""
    corpus = [RNG.normal(size=DIM) for _ in range(240)]
    for i in range(0, 240, 3):
        corpus[i] = np.arange(1.0, DIM + 1)
    queries = [RNG.normal(size=DIM) for _ in range(15)] + [np.arange(1.0, DIM + 1)]
    return queries, corpus


def frames(spark, data, parts=5):
    queries, corpus = data
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id int, embedding array<double>")
    c = spark.createDataFrame([(f"d{i:03}", v.tolist()) for i, v in enumerate(corpus)], "doc_id string, embedding array<double>")
    return q, c.repartition(parts)


def brute(data, k, metric):
    queries, corpus = data
    out = {}
    for qi, q in enumerate(queries):
        scored = [(BRUTE[metric](q, c), f"d{i:03}") for i, c in enumerate(corpus)]
        scored.sort(key=lambda x: (x[0] is None, -round(x[0], 9) if x[0] is not None else 0, x[1]))
        out[qi] = [(d, s) for s, d in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"], r["rank"]))
    return out


def assert_same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [d for d, _, _ in got[q]] == [d for d, _ in want[q]], q
        assert [r for _, _, r in got[q]] == list(range(1, len(want[q]) + 1))
        for (_, g, _), (_, w) in zip(got[q], want[q]):
            assert (g is None) == (w is None) and (w is None or abs(g - w) < 1e-8)


@pytest.mark.parametrize("held, block", [("queries", 1), ("corpus", 1), (None, 1 << 20), (None, 900)])
@pytest.mark.parametrize("k", [1, 5, 400])
def test_top_k_is_exact_on_every_path(spark, data, held, block, k):
    q, c = frames(spark, data)
    assert_same(found(top_k(q, c, k, held=held, block_bytes=block)), brute(data, k, "cosine"))


def counted(folder):
    """A loader whose model notes every call in a file, and the number of texts noted."""
    path = str(folder / "calls")

    def counting():
        def model(texts):
            with open(path, "a") as notes:
                notes.write(f"{len(texts)}\n")
            return np.array([[len(t), 1.0] for t in texts])

        return model

    return counting, lambda: sum(map(int, open(path).read().split()))


@pytest.mark.parametrize("held, block", [("queries", 1), ("corpus", 1), (None, 1 << 20), (None, 900)])
@pytest.mark.parametrize("n", [50, 2500])
def test_every_text_goes_through_the_model_once(spark, tmp_path, held, block, n):
    counting, calls = counted(tmp_path)
    queries = spark.range(n).selectExpr("id as query_id", "repeat('x', cast(id % 9 as int)) as text")
    corpus = spark.range(300).selectExpr("id as doc_id", "repeat('y', cast(id % 7 as int)) as text")
    asked, stored = embed_texts(queries, "text", counting), embed_texts(corpus, "text", counting)
    hits = top_k(asked, stored, 3, held=held, block_bytes=block)
    assert hits.count() == 3 * n
    assert calls() == n + 300


def test_evaluation_embeds_once_for_all_its_results(spark, tmp_path):
    counting, calls = counted(tmp_path)
    records = spark.range(200).selectExpr("cast(id as string) as doc_id", "repeat('ab ', cast(id % 9 as int)) as text")
    queries = spark.range(30).selectExpr("id as query_id", "'ab' as query", "'ab' as query_fr", "cast(id as string) as doc_id")
    result = evaluate_search(queries, records, counting)
    result.metrics.collect(), result.predictions.collect(), result.predictions.count()
    assert calls() == 230


def test_loaders_do_not_share_a_model(spark):
    df = spark.createDataFrame([(i, "x") for i in range(40)], "id int, t string")

    def loader(value):
        return lambda: lambda texts: np.full((len(texts), 1), value)

    for value in (1.0, 2.0):
        got = embed_texts(df, "t", loader(value)).select("embedding").distinct().collect()
        assert [r[0] for r in got] == [[value]]


def test_only_the_text_goes_to_the_model(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, t string, payload string")
    out = embed_texts(df, "t", lambda: lambda texts: np.ones((len(texts), 1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and plan.count("ArrowEvalPython") == 1


def test_search_from_texts(spark):
    def words():
        return lambda texts: np.array([[t.count("lake") + 0.1, t.count("river") + 0.1] for t in texts])

    q = spark.createDataFrame([(1, "lake"), (2, None)], "query_id int, text string")
    c = spark.createDataFrame([(1, "river"), (2, "lake lake"), (3, None)], "doc_id int, text string")
    assert [d for d, _, _ in found(search(q, c, words, 1, "euclidean"))[1]] == [2]
    assert [d for d, _, _ in found(search(q, c, words, 2))[1]] == [2, 1]


def test_null_vectors_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    c = spark.createDataFrame([(4, None)], "doc_id int, embedding array<float>")
    with pytest.raises(Exception, match="no vector for doc_id 4"):
        top_k(q, c, 3).collect()


@pytest.mark.parametrize("metric", DISTANCES)
def test_metrics_of_distance(spark, data, metric):
    q, c = frames(spark, data)
    assert_same(found(top_k(q, c, 7, metric)), brute(data, 7, metric))


def test_zero_vectors_rank_last(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0, 1.0])], "doc_id int, embedding array<float>")
    assert [(d, s) for d, s, _ in found(top_k(q, c, 3))[1]] == [(3, pytest.approx(2**-0.5)), (2, -1.0), (1, None)]


def test_empty_sides(spark, data):
    q, c = frames(spark, data)
    assert top_k(q.where("false"), c, 3).count() == 0
    assert top_k(q, c.where("false"), 3).count() == 0
    assert top_k(q, c.where("false"), 3, block_bytes=10).count() == 0


def test_search_arguments(spark, data):
    q, c = frames(spark, data)
    with pytest.raises(ValueError):
        top_k(q, c, 0)
    with pytest.raises(ValueError):
        top_k(q, c, 1, "nearest")


def test_no_pairs_in_the_plan(spark, data):
    q, c = frames(spark, data)
    plan = top_k(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("WindowGroupLimit") == 4
    words = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    texts = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    plan = keyword_first(words, texts)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("held, block", [(True, 1), (False, 1000), (False, 2)])
def test_keyword_first(spark, held, block):
    rng = np.random.default_rng(3)
    letters = list("abcdefgh")
    texts = ["".join(rng.choice(letters, 12)).upper() for _ in range(300)]
    texts[::3] = ["ABACUS"] * 100
    queries = {1: "aba  zzz", 2: "Hgf cab", 3: "zzzz", 4: " \t", 5: "h", 6: "ABACUS", 7: "fghabc"}
    q = spark.createDataFrame(list(queries.items()), "query_id int, text string")
    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None)], "doc_id int, text string")
    got = {}
    for r in sorted(keyword_first(q, c.repartition(7), 5, held, block).collect()):
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    for qid, text in queries.items():
        hits = [i for i, t in enumerate(texts) if any(w in t.lower() for w in text.lower().split())][:5]
        assert [d for _, d in sorted(got.get(qid, []))] == hits


# --- measures -----------------------------------------------------------------------------------------


@pytest.fixture
def results(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "b", 1), (2, "a", 2), (3, "c", 1), (4, "x", 6)]
    return spark.createDataFrame(rows, "query_id int, doc_id string, rank int").withColumn("score", 1.0 / F.col("rank"))


def test_single_label_measures(spark, results):
    labels = spark.createDataFrame([(1, "c"), (2, "b"), (3, "z"), (4, "x"), (5, None)], "query_id int, doc_id string")
    row = M.evaluate(results, labels, 5).first()
    assert row["labelled"] == 4
    assert row["acc_at_k"] == pytest.approx(2 / 4)
    assert row["mrr_at_k"] == pytest.approx((1 / 3 + 1) / 4)
    empty = M.evaluate(results, labels.where("false"), 5).first()
    assert empty["labelled"] == 0 and empty["acc_at_k"] is None


def test_first_listed_counts_not_the_best(spark, results):
    listed = spark.createDataFrame(
        [(1, ["c", "a", "z"]), (2, ["z", "b"]), (3, ["z"]), (1000, ["a"]), (4, [])], "query_id int, related_documents array<string>"
    )
    row = M.first_listed_mrr(results, listed).first()
    assert row["queries"] == 5
    assert row["mrr"] == pytest.approx((1 / 3 + 1) / 5)
    short = spark.createDataFrame([(1, ["c"])], "query_id int, related_documents array<string>")
    assert M.first_listed_mrr(results, short).first()["mrr"] == 0.0


def test_models_side_by_side(spark, results):
    both = results.withColumn("model", F.lit("m1")).union(results.where("query_id = 1").withColumn("model", F.lit("m2")))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, doc_id string")
    labels = one.withColumn("model", F.lit("m1")).union(one.withColumn("model", F.lit("m2")))
    got = {r["model"]: r["acc_at_k"] for r in M.evaluate(both, labels, 5, ["model"]).collect()}
    assert got == {"m1": 1.0, "m2": 0.5}


def test_predictions_and_answers(spark, results):
    labels = spark.createDataFrame([(1, "c"), (9, "q"), (2, None)], "query_id int, doc_id string")
    got = {r["query_id"]: (r["doc_id"], r["top_ids"]) for r in M.predictions(results, labels).collect()}
    assert got == {1: ("c", ["a", "b", "c"]), 9: ("q", [])}
    queries = spark.createDataFrame([(1,), (9,)], "query_id int")
    best = {r["query_id"]: (r["doc_id"], r["score"]) for r in M.best_answers(queries, results).collect()}
    assert best == {1: ("a", 1.0), 9: (None, None)}


# --- vectors --------------------------------------------------------------------------------------------


def test_pooling_and_norms(spark):
    tokens = RNG.normal(size=(4, 3))
    rows = [(tokens.tolist(), [1, 0, 1, 1]), (tokens.tolist(), [0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "t array<array<double>>, m array<int>")
    pooled = [r[0] for r in df.select(V.mean_pool(F.col("t"), F.col("m"))).collect()]
    assert np.allclose(pooled[0], tokens[[0, 2, 3]].mean(axis=0))
    assert np.allclose(pooled[1], 0)
    unit = [r[0] for r in df.select(V.l2_normalize(F.get("t", F.lit(0)))).collect()]
    assert np.allclose(unit[0], tokens[0] / np.linalg.norm(tokens[0]))
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(V.l2_normalize(F.col("a"))).first()[0] == [0.0, 0.0]
    assert zero.select(V.cosine(F.col("a"), F.col("b"))).first()[0] is None
    assert zero.select(V.cosine(F.col("b"), F.col("b"))).first()[0] == 1.0


# --- pairs and models -----------------------------------------------------------------------------------


def test_pairs(spark):
    df = spark.createDataFrame([(1, "One. Two! Three?\nFour"), (2, "Only one."), (3, ""), (4, None)], "id int, t string")
    got = [tuple(r) for r in adjacent_pairs(df, "id", "t").orderBy("record_id", "pos").collect()]
    assert got == [(1, 0, "One.", "Two!"), (1, 1, "Two!", "Three?"), (1, 2, "Three?", "Four")]
    got = [tuple(r) for r in text_halves(df, "id", "t").orderBy("record_id").collect()]
    assert got[:3] == [(1, "One. Two!", "Three? Four"), (2, "", "Only one."), (3, "", "")]

    @F.pandas_udf("array<string>")
    def by_bar(s):
        return s.map(lambda t: t.split("|"))

    bars = spark.createDataFrame([(1, "a|b|c")], "id int, t string")
    assert [tuple(r) for r in text_halves(bars, "id", "t", by_bar).collect()] == [(1, "a", "b c")]


def test_embed_texts(spark):
    def length_model():
        def model(texts):
            assert len(texts) <= 3
            return np.array([[len(t), 1.0] for t in texts])

        return model

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, t string").repartition(2)
    out = embed_texts(df, "t", length_model, batch_size=3)
    assert out.columns == ["id", "t", "embedding"] and df.columns == ["id", "t"]
    assert {r["id"]: r["embedding"] for r in out.collect()} == {i: [i, 1.0] for i in range(10)}
    with pytest.raises(ValueError):
        embed_texts(df, "absent", length_model)
    with pytest.raises(ValueError):
        embed_texts(df, "t", length_model, batch_size=0)


def test_generate_questions(spark):
    df = spark.createDataFrame([(1, "lake"), (2, "river")], "id int, t string")
    out = generate_questions(df, "t", "q", lambda: lambda texts: [f" What is the {t}? " for t in texts])
    assert {r["id"]: r["q"] for r in out.collect()} == {1: "lake?", 2: "river?"}
    with pytest.raises(ValueError):
        generate_questions(df, "absent", "q", lambda: list)


def test_wrong_number_of_results(spark):
    df = spark.createDataFrame([(1, "lake")], "id int, t string")
    with pytest.raises(Exception, match="gave 0 results for 1 texts"):
        generate_questions(df, "t", "q", lambda: lambda texts: []).collect()


def test_evaluation_end_to_end(spark):
    def word_model():
        words = ["lake", "river", "forest"]
        return lambda texts: np.array([[t.lower().count(w) + 0.01 for w in words] for t in texts])

    records = spark.createDataFrame(
        [("r1", "Lake lake"), ("r2", "River and lake"), ("r3", "forest"), ("r4", "river river")], "doc_id string, text string"
    )
    queries = spark.createDataFrame(
        [(1, "lake", "lake", "r1"), (2, "river", "nothing", "r2"), (3, "forest", "forest", "r9"), (4, "x", "x", None)],
        "query_id int, query string, query_fr string, doc_id string",
    )
    result = evaluate_search(queries, records, word_model)
    row = result.metrics.first()
    assert row["labelled"] == 3
    assert row["acc_at_k"] == pytest.approx(2 / 3)
    assert row["mrr_at_k"] == pytest.approx((1 + 1 / 2) / 3)
    assert row["keyword_acc_at_k"] == pytest.approx(1 / 3)
    top = {r["query_id"]: r["top_ids"] for r in result.predictions.collect()}
    assert top[2][:2] == ["r4", "r2"] and len(top) == 3


def test_evaluation_of_files(spark, tmp_path, capsys):
    from textprep_spark import fixed_values as fv
    from textprep_spark.plans.evaluate import evaluate_files

    def word_model():
        return lambda texts: np.array([[t.lower().count(w) + 0.01 for w in ("lake", "river")] for t in texts])

    parts = [fv.ID] + [f"{fv.P}{p}_en" for p in ("title", "description", "keywords")]
    rows = [("r1", "Lake", None, "a"), ("r2", "River", "wide", "b"), ("r3", "Both", "lake river", "c")]
    records = str(tmp_path / "records.parquet")
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in parts)).write.parquet(records)
    labels = tmp_path / "labels.csv"
    labels.write_bytes("query,query-fr,doc_id\nlake,wide,r1\nlake,wide,r1\nriver,forêt,r2\nx,y,\n".encode("latin-1"))
    metrics = evaluate_files(spark, str(labels), records, str(tmp_path), word_model, "some/words", k=1).first()
    (tmp_path / "own_models.py").write_text("def load():\n    return lambda texts: [[float(t.lower().count('lake')) + 0.01] for t in texts]\n")
    sys.path.insert(0, str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "own_models.py"))
    evaluate_main(["--labels", str(labels), "--records", records, "--output-dir", str(tmp_path), "--loader", "own_models:load", "--model", "lakes", "--k", "1"])
    assert '"labelled":3' in capsys.readouterr().out
    assert metrics["labelled"] == 3
    assert metrics["acc_at_k"] == metrics["mrr_at_k"] == 1.0
    assert metrics["keyword_acc_at_k"] == 0.0
    written = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "predicted_words"))
    assert sorted(tuple(r) for r in written.collect()) == [("r1", '["r1"]'), ("r1", '["r1"]'), ("r2", '["r2"]')]

import random

import pytest

from textprep_spark.llm import mixing


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, size string, rank int")


def wanted(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, fixed = share * sum(sizes.values()), {}
    while True:
        rest = goal - sum(fixed.values())
        open_ = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / total for s in open_}
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def rows():
    chance, rows = random.Random(6), []
    for source, n in (("a", 400), ("é", 90), ("Z", 60), ("b", 30), (None, 50), ("", 40)):
        for _ in range(n):
            words = chance.choice([3, 20, 60, 60, 200, 900])
            rows.append((len(rows), source, " ".join(["w"] * words), "x", 1))
    return rows


def test_targets_and_copies(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    got = mixing.mix(documents(spark, rows)).collect()
    sizes = {}
    for _, s, t, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    aims = wanted(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(aims[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, aim in aims.items():
        assert abs(taken[s] - aim) <= 0.02 * aim


def test_reruns_agree_whatever_the_partitioning(spark, rows):
    df = documents(spark, rows)
    once = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()}
    assert once == again


def test_rates_are_tilted_base_rates(spark, rows):
    got = mixing.mix(documents(spark, rows)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.rate * r.size for r in own) == pytest.approx(own[0].target)
        short = {r.rate for r in own if r.size < 50}
        long = {r.rate for r in own if r.size >= 50}
        assert len(short) == len(long) == 1
        assert min(2.0, 2 * short.pop()) == pytest.approx(long.pop()) or max(r.rate for r in own) == 2


def test_odd_tables(spark):
    rows = [(1, None, None, "x", 1), (2, "a", "", "x", 1), (3, "b", "w " * 90, "x", 1), (3, "b", "w " * 90, "x", 1), (None, "b", "w", "x", 1)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == 5
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert sum(r.taken for r in got) in range(180, 363)
    assert mixing.mix(documents(spark, [])).collect() == []

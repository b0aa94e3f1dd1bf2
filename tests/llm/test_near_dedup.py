import random

import numpy as np
import pytest

from textprep_spark.llm import near_dedup
from textprep_spark.llm.components import components


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words.encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def least(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {i: root(i) for i in ids}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[:k]
        if x and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return {(i, len(s), c) for (i, s), c in zip(sets, map(least([i for i, _ in sets], links).get, (i for i, _ in sets)))}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, key long, component string")
    return near_dedup.near_duplicates(df).collect()


@pytest.mark.parametrize("block", [2, 256])
def test_groups_of_mutated_texts(spark, monkeypatch, block):
    """Members of a group are often similar through others only."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    chance, rows = random.Random(block), []
    for _ in range(12):
        base = [f"w{chance.randint(0, 300)}" for _ in range(chance.choice([8, 40, 120]))]
        for _ in range(chance.randint(1, 25)):
            words = list(base)
            for _ in range(chance.randint(0, 4)):
                words[chance.randrange(len(words))] = f"x{chance.randint(0, 9)}"
            rows.append((len(rows), " ".join(words)))
            if chance.random() < 0.3:
                base = words
    chance.shuffle(rows)
    got = found(spark, rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, "a b"), (7, "a b"), (8, "é b"), (9, "É b")]
    rows.append((10, " ".join(f"v{i}" for i in range(200_000))))
    got = found(spark, rows + [(None, "a b")])
    assert len(got) == 12
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id} == brute(rows[:-1]) | {(10, 199_996, 10)}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None][0][1] in (True, False)
    assert found(spark, []) == []


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_of_one_id_with_different_texts(spark, parts):
    """Each text is compared for itself, however the rows are dealt."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "more"])), (8, " ".join([*b, "more"])), (5, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(5, 5, True)] * 3 + [(7, 5, False), (8, 5, False)]


def test_pruning_bound_spares_similar_pairs():
    chance = np.random.default_rng(0)
    for n, least_ in zip((32, 64, 96, 128), near_dedup.least_matches()):
        assert (chance.binomial(n, 0.75, 200_000) < least_).mean() < 1e-3


def test_components(spark):
    chance = random.Random(5)
    links = [(i, i + 1) for i in range(300)]  # a path, the slowest case
    links += [(1000 + chance.randint(0, 400), 1000 + chance.randint(0, 400)) for _ in range(250)]
    links += [(2000, 3000 + i) for i in range(500)] + [(2000, 3000)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    nodes = {x for link in links if link[0] != link[1] for x in link}
    assert got == {k: v for k, v in least(sorted({x for link in links for x in link}), links).items() if k in nodes}
    assert components(df.limit(0), "a", "b").collect() == []

import numpy as np
import pytest

from tests.llm.test_near_dedup import least
from textprep_spark.llm import embedding_dedup as e


def unlinked(v):
    return v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v)


def brute(rows):
    usable = [(i, np.array(v, dtype=float) / max(map(abs, v))) for i, v in rows if not unlinked(v)]
    links = []
    for k, (a, x) in enumerate(usable):
        for b, y in usable[:k]:
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                links.append((a, b))
    component = least([i for i, _ in rows], links)
    return {i: (sum(i in link for link in links), component[i]) for i, _ in rows}


def found(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, node int")
    got = e.near_duplicates(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


@pytest.mark.parametrize("block, cell", [(8, 4), (1024, 128)])
def test_groups_of_near_copies(spark, monkeypatch, block, cell):
    monkeypatch.setattr(e, "BLOCK", block)
    monkeypatch.setattr(e, "PER_CELL", cell)
    chance, rows = np.random.default_rng(block), []
    for size in [1] * 150 + [2] * 20 + [30, 60, 5]:
        base = chance.normal(size=24)
        for _ in range(size):
            noise = chance.normal(size=24) * np.linalg.norm(base) / 5
            rows.append((len(rows), (base + noise * chance.choice([0, 0.3, 0.6, 0.9])).tolist()))
    want, got = brute(rows), found(spark, rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[i] == want[i] for i in want]) > 0.95


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []), (7, [1.0, 0.0]), (8, [3.0, 0.1]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [1e200, 0.0]), (13, [2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}
    assert found(spark, [(1, [0.5] * 8), (2, [0.5] * 8), (3, None)], "float") == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_a_repeated_id_is_a_row_of_its_own(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in e.near_duplicates(df).collect()) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def in_subspace(chance, n, dims, rank):
    """Unit vectors of a low-rank table, and for each another at the very cosine of a link."""
    basis = np.linalg.qr(chance.normal(size=(dims, rank)))[0].T
    x, aside = e.unit(chance.normal(size=(n, rank))), chance.normal(size=(n, rank))
    aside = e.unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    return x @ basis, (0.95001 * x + np.sqrt(1 - 0.95001**2) * aside) @ basis


@pytest.mark.parametrize("rank", [8, 16, 64])
def test_low_rank_vectors_find_each_other(rank):
    x, y = in_subspace(np.random.default_rng(rank), 8000, 64, rank)
    a, b = x[6000:], y[6000:]
    index = e.fit_index(x[:6000], 10_368, 0.95, 0.995)  # nine words a codebook
    met = index.goes_to(a, index.home(b)) | index.goes_to(b, index.home(a))
    assert met.mean() > 0.985


def test_the_margin_holds_for_true_links(spark):
    """Copies that are moved towards other groups of the table only."""
    chance, rows = np.random.default_rng(5), []
    base = e.unit(chance.normal(size=(700, 32)))
    for i, x in enumerate(base):
        near = base[np.argsort(-(base @ x))[1:4]].sum(axis=0)
        near = near - (near @ x) * x
        rows += [x, 0.951 * x + np.sqrt(1 - 0.951**2) * near / np.linalg.norm(near)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    want, got = brute(rows), found(spark, rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())

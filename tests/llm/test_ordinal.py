import random

import numpy as np

from textprep_spark.llm import ordinal


def corpus(n, seed):
    """Grade 2 plain, 1 with foul words, 0 shouted."""
    chance, rows, grades = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{chance.randint(0, 3000)}" for _ in range(chance.randint(55, 120))]
        grade = chance.choice([0, 1, 2, 2])
        if grade == 1:
            words[5] = words[30] = chance.choice(["foul", "vile", "rotten"])
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        grades.append((i, grade))
    return rows, grades


def frames(spark, rows, grades):
    return (
        spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, grade int"),
        spark.createDataFrame(grades, "doc_id long, grade int"),
    )


def test_held_out_grades(spark):
    rows, grades = corpus(1600, 1)
    documents, rated = frames(spark, rows, grades[:1000])
    got = {r.doc_id: r for r in ordinal.grade(documents, ordinal.fit(documents, rated)).collect()}
    mean = {g: np.mean([got[i].expected_grade for i, x in grades[1000:] if x == g]) for g in (0, 1, 2)}
    assert mean[0] < mean[1] < mean[2] and mean[2] > 1.7 and mean[0] < 0.5
    kept = {g: np.mean([got[i].kept for i, x in grades[1000:] if x == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.98 and kept[0] < 0.05 and kept[1] < 0.6


def test_fit_has_ordered_thresholds_and_recovers_an_order():
    chance = np.random.default_rng(2)
    x = chance.normal(size=4000)
    grades = np.digitize(2 * x + chance.logistic(size=4000), [-1.0, 0.5, 2.0])
    weights, cuts = ordinal.fit_ordinal(np.arange(4000), np.zeros(4000, dtype=int), x, grades, 1)
    assert abs(weights[0] - 2) < 0.3 and np.allclose(cuts, [-1.0, 0.5, 2.0], atol=0.3)
    assert (np.diff(cuts) > 0).all()


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "w " * 200_000)]
    for grades in ([], [(1, 2), (2, 2)], [(1, 0), (3, 1), (3, 1), (None, 0), (2, None)]):
        documents, rated = frames(spark, rows, grades)
        got = ordinal.grade(documents, ordinal.fit(documents, rated)).collect()
        assert len(got) == 6 and all(0 <= r.tail <= 1 for r in got)
        assert ordinal.grade(documents.limit(0), ordinal.fit(documents.limit(0), rated)).collect() == []
        if len({g for i, g in grades if i and g is not None}) < 2:
            assert all(r.kept for r in got)


def test_wrong_labels_do_not_set_the_cut(spark):
    """Some texts with foul words are rated best; one foul word must be enough, ten not too many."""
    rows, grades = corpus(3000, 3)
    chance, given = random.Random(4), []
    for i, g in grades:
        if g == 1:
            words = rows[i][1].split()
            for place in range(chance.choice([1, 1, 10])):
                words[place] = chance.choice(["foul", "vile", "rotten", "bad1", "bad2", "bad3"])
            words[30] = words[0]
            rows[i] = (i, " ".join(words))
        given.append((i, 2 if g == 1 and chance.random() < 0.03 else g))
    documents, rated = frames(spark, rows, given[:2000])
    got = {r.doc_id: r for r in ordinal.grade(documents, ordinal.fit(documents, rated)).collect()}
    kept = {g: np.mean([got[i].kept for i, x in grades[2000:] if x == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.97 and kept[0] < 0.02 and kept[1] < 0.1


def test_words_are_known_by_their_beginnings(spark):
    """The words of poor texts are all different and begin alike."""
    rows, grades = corpus(1500, 5)
    poor = [i for i, g in grades if g == 0]
    for i in poor:
        rows[i] = (i, " ".join([f"w{k}x{i}" for k in range(60)] + [f"slander{i}"]))
    documents, rated = frames(spark, rows, grades[:1000])
    got = {r.doc_id: r for r in ordinal.grade(documents, ordinal.fit(documents, rated)).collect()}
    kept = {g: np.mean([got[i].kept for i, x in grades[1000:] if x == g]) for g in (0, 2)}
    assert kept[2] > 0.97 and kept[0] < 0.02


def test_the_cut_weighs_both_sides():
    best = np.concatenate([[0.001], np.linspace(0.6, 1, 999)])
    cut = ordinal.choose_cut(best, np.array([0.0005, 0.2, 0.4, 0.99]))
    assert 0.4 < cut < 0.62
    assert ordinal.choose_cut(np.array([]), np.array([0.5])) == 0.0
    assert ordinal.choose_cut(np.array([0.4, 0.5]), np.array([])) == 0.4

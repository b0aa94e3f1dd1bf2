"""The conversation trie against a plain one, and the parts it is made of."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textprep_spark.llm import catalog, ordered, trie

SCHEMA = "conv_id long, turn long, role string, text string, at string, words string"


def plain_trie(rows):
    """What the query returns, conversation by conversation."""
    said = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        said.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c, own in said.items():
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own if base == c else said.get(base, [])[:h] + own[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, convs in members.items():
        words = len(path[-1][1].split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * words
    out = set()
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(path))
        out.add(
            (min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children.get(path, ())),
             leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def returned(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalog.op13_conversation_trie(spark, str(tmp_path))
    assert set(df.columns) == set(COLUMNS)
    found = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


def random_rows(seed, conversations, longest):
    chance, rows = random.Random(seed), []
    for c in chance.sample(range(-60, 3 * conversations), conversations):
        for turn in range(chance.randint(1, longest)):
            role = chance.choice(["user", "assistant", None])
            text = chance.choice(["a", "a b", "", None, "a\nb  c"])
            rows.append((c, chance.choice([turn, turn, turn, None, 1]), role, text, "x", "y"))
    rows += rows[:5] + [(None, 1, "user", "lost", "x", "y")]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, conversations, longest", [(1, 60, 6), (2, 300, 3), (3, 4, 90)])
def test_against_a_plain_trie(spark, tmp_path, monkeypatch, seed, conversations, longest):
    monkeypatch.setattr(trie.prefix_trie, "__defaults__", (16,))  # contract in many rounds
    rows = random_rows(seed, conversations, longest)
    assert returned(spark, tmp_path, rows) == plain_trie(rows)


def test_copies_and_turnless_conversations(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t}", "", "") for c in range(40, 140) for t in range(2)]
    rows += [(20 * k + 1 + i, 0, "user", "only", "", "") for k in range(10, 14) for i in range(9)]
    assert any(zlib.crc32(str(r[0]).encode()) % 4 for r in rows[200:])  # some of them lose their turn
    assert returned(spark, tmp_path, rows) == plain_trie(rows)


def test_no_conversations(spark, tmp_path):
    assert returned(spark, tmp_path, [(None, 1, "user", "x", "", "")]) == set()


@pytest.mark.parametrize("n, few", [(1, 4), (5, 4), (700, 1), (700, 50)])
def test_ranks_of_a_list(spark, n, few):
    arcs = list(range(n))
    random.Random(n).shuffle(arcs)
    rows = [(a, b) for a, b in zip(arcs, [*arcs[1:], None])]
    random.Random(1).shuffle(rows)
    got = trie.ranked_list(spark.createDataFrame(rows, "arc long, next long"), few).collect()
    assert {r.arc: r["rank"] for r in got} == {a: i for i, a in enumerate(arcs)} and len(got) == n


def test_running_sums_and_successors(spark):
    rows = [(1 if i < 500 else i // 10, i, i % 7) for i in range(900)]  # one group fills most ranges
    df = spark.createDataFrame(random.Random(5).sample(rows, 900), "g long, i long, x long")
    placed = ordered.in_order(df, ["g", "i"], ["g", "i", "x"], "test")
    summed = ordered.running(placed, {"all": F.col("x"), "n": F.lit(1)}).collect()
    assert {r.i: (r["all"], r.n) for r in summed} == {i: (sum(k % 7 for k in range(i + 1)), i + 1) for i in range(900)}
    grouped = ordered.running(placed, {"own": F.col("x")}, ["g"]).collect()
    for r in grouped:
        assert r.own == sum(x for g, i, x in rows if g == r.g and i <= r.i)
    after = {r.i: r.after and r.after.i for r in ordered.followed(placed, ["i"]).collect()}
    assert after == {i: i + 1 if i < 899 else None for i in range(900)}
    assert ordered.running(placed.limit(0), {"all": F.col("x")}).count() == 0


def test_digests_run_over_many_strings(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    none = "cast(0 as decimal(38,0))"
    df = spark.range(2000).selectExpr(
        "id as conv_id", "id % 3 div 2 as depth", f"{none} as s", f"{none} as t", "id <> 7 as last"
    )
    got = {r.depth: r.ends_sha256 for r in trie._digests(df).collect()}
    for depth in (0, 1):
        ids = [i for i in range(2000) if i % 3 // 2 == depth and i != 7]
        assert got[depth] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

import random

from pyspark.sql import functions as F

from textprep_spark.llm import chat

SCHEMA = "conv_id long, seq long, message_id string, kind string, role string, text string"


def rendered(spark, events):
    df = chat.render(chat.reconstruct(spark.createDataFrame(events, SCHEMA)))
    df = df.select("*", chat.read_back(F.col("formatted")).alias("turns"))
    df = df.select("*", chat.learned_text(F.col("pieces")).alias("learned"))
    return {r.conv_id: r for r in df.collect()}


def turns(row):
    return [tuple(t) for t in row.turns]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 3, "b", "delta", None, "lo"),
        (1, 0, "a", "message", "user", "hey"),
        (1, 1, "b", "message", "assistant", ""),
        (1, 2, "b", "delta", None, "hel"),
        (1, 4, "b", "regenerate", None, None),
        (1, 5, "b", "delta", None, "good "),
        (1, 7, "a", "edit", None, "hi"),
        (1, 6, "b", "delta", None, "day"),
        (1, 8, "c", "delta", "user", "bye"),
        (2, 1, "x", "message", "assistant", "one"),
    ]
    random.Random(2).shuffle(events)
    got = rendered(spark, events)
    assert turns(got[1]) == [("user", "hi"), ("assistant", "good day"), ("user", "bye")]
    assert got[1].learned == "good day" and got[2].learned == "one"


def test_hostile_texts_come_back(spark):
    chance = random.Random(3)
    parts = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "assistant", "\n", "$1", "é", "<\\|", ""]
    texts = ["".join(chance.choices(parts, k=chance.randint(0, 8))) for _ in range(400)]
    events = [(i // 4, i, str(i), "message", chance.choice(texts[:9] + ["assistant"]), t) for i, t in enumerate(texts)]
    for c, row in rendered(spark, events).items():
        own = [e for e in events if e[0] == c]
        assert turns(row) == [(e[4], e[5]) for e in own]
        assert row.learned == "".join(e[5] for e in own if e[4] == "assistant")
        assert row.formatted.count("<|im_start|>") == len(own)
        assert row.formatted == "".join(p.text for p in row.pieces)


def test_nulls_ties_and_repeated_rows(spark):
    events = [
        (None, 1, None, "message", None, None),
        (None, None, None, "message", "user", "first"),
        (5, 1, "m", "message", "user", "b"),
        (5, 1, "m", "message", "user", "a"),
        (5, 1, "m", "message", "user", "a"),
    ]
    got = rendered(spark, events)
    assert turns(got[None]) == [("user", "first"), ("", "")]
    assert turns(got[5]) == [("user", "a"), ("user", "a"), ("user", "b")]
    assert rendered(spark, []) == {}


def test_long_conversation(spark):
    events = [(1, i, str(i), "message", "user", f"t{i} " * 20) for i in range(20_000)]
    row = rendered(spark, events)[1]
    assert turns(row) == [("user", f"t{i} " * 20) for i in range(20_000)]


def test_the_query_folds_events(spark, tmp_path):
    """Every turn is taken apart into a log and put together again, null and repeated turns too."""
    from textprep_spark.llm import catalog

    rows = [(1, None, "user", "first"), (1, 2, "assistant", "é😀b"), (1, 1, None, None), (1, 2, "assistant", "é😀b"), (1, 1, "user", "x"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = catalog._as_events(df)
    assert log.count() == 6 * len(rows) and {r.kind for r in log.collect()} == set(chat.KINDS)
    got = {r.conv_id: [(m.role, m.text) for m in r.messages] for r in chat.reconstruct(log.repartition(4)).collect()}
    assert got == {1: [("user", "first"), ("", ""), ("user", "x"), ("assistant", "é😀b"), ("assistant", "é😀b")], 2: [("user", "")]}

import random

import pytest
from pyspark.sql import functions as F

from textprep_spark.llm import url_filter as u

RULES = (u.Rule("allow", "org", "/"), u.Rule("block", "a.org", "/x/"), u.Rule("block", "com", "/de/"))


@pytest.mark.parametrize("largest", [u.MAX_BYTES, 0])
def test_membership_is_exact(spark, monkeypatch, largest):
    monkeypatch.setattr(u, "MAX_BYTES", largest)
    chance = random.Random(9)
    keys = [f"k{i}" for i in range(6000)] + ["", "é"]
    listed = set(chance.sample(keys, 1500)) | {""}
    df = spark.createDataFrame([(k, 1) for k in keys + keys[:50]] + [(None, 1)], "key string, listed int").drop("listed")
    table = u.universe(df, spark.createDataFrame([(k,) for k in listed], "key string"))
    if largest:
        assert len(u.build_cascade(table).levels) > 2
    rows = u.with_membership(df, F.col("key"), table, "found").collect()
    assert len(rows) == len(keys) + 51
    assert all(r.found == (r.key in listed) for r in rows)


def test_urls_and_rules(spark):
    urls = {
        "http://B.A.ORG/x/1?q=/y": ("b.a.org", "/x/1", "a.org/x/", "block"),
        "http://a.org/x": ("a.org", "/x", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "x://ya.org#/x/": ("ya.org", "", None, "allow"),
        "://É.com/de/?": ("É.com", "/de/", "com/de/", "block"),
        "http://com/de": ("com", "/de", None, "block"),
        "nothing": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, x, "z") for i, x in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("com/de",), ("com/de",), (None,)], "key string")
    rows = u.judge(pages.union(pages), RULES, listed).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == list(urls.values())[r.page_id]
    assert u.judge(pages.limit(0), RULES, listed.limit(0)).collect() == []
    assert {r.verdict for r in u.judge(pages, (), listed.limit(0)).collect()} == {"allow"}

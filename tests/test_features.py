"""JSON features, themes, document texts, cleaning."""

import json

import pytest
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions import jsoncols as J
from textprep_spark.functions import themes as TH
from textprep_spark.functions.documents import PARALLEL, plain_record_text, record_text
from textprep_spark.operators import cleaning
from textprep_spark.operators.normalize import normalize_columns
from textprep_spark.functions.text import LanguageConfig

P = fv.P


def desc(*texts, lang="en"):
    return json.dumps([{"description": {lang: t}} for t in texts])


DESCRIPTIONS = [
    (desc("First option; extra info", "Second option; more info"), ["First option", "Second option"]),
    (desc("Same; a", "Same; b"), ["Same"]),
    ('{"description": {"en": " One ; x"}}', ["One"]),
    ('{"description": {"fr": "Un"}}', []),
    ('[{"description": {"en": 5}}, {"description": {"en": "ok"}}]', ["ok"]),
    ('[{"description": null}, {"description": {"en": "ok"}}]', []),
    ('[{"description": "text"}, {"description": {"en": "ok"}}]', []),
    ('[{"description": []}]', []),
    ('[3, null, "x", [], {"other": 1}, {"description": {"en": "ok"}}]', ["ok"]),
    ('[{"description": {"en": ""}}]', [""]),
    ("invalid json", []),
    ("[{'description': {'en': 'single quotes'}}]", []),
    (desc("cut") + " trailing", []),
    (desc("cut") + "]", []),
    (desc("cut") + ",1", []),
    ('{"description": {"en": "a"}, "description": {"en": "b"}}', ["b"]),
    ("[]", []),
    ("5", []),
    ("", []),
    (None, []),
]


def test_option_descriptions(spark, apply):
    J.accept_repeated_keys(spark)
    got = apply(lambda c: J.option_descriptions(J.parse(c)), [c for c, _ in DESCRIPTIONS])
    assert got == [want for _, want in DESCRIPTIONS]


def test_option_descriptions_in_french(apply):
    got = apply(lambda c: J.option_descriptions(J.parse(c), "fr"), [desc("Un; x", lang="fr"), desc("One")])
    assert got == [["Un"], []]


def test_mappable(apply):
    cases = {
        '[{"protocol": "ESRI REST API"}]': "true",
        '[{"protocol": "HTTP"}, {"protocol": " ogc wms "}]': "true",
        '{"protocol": "OGC"}': "true",
        '[{"protocol": "HTTP"}]': "false",
        '[{"name": "x"}]': "false",
        '[{"protocol": null}, {"protocol": "ogc"}]': "false",
        '[{"protocol": 7}, {"protocol": "ogc"}]': "false",
        '["ogc"]': "false",
        '"ogc"': "false",
        "ogc": "false",
        "[]": "false",
        None: "false",
    }
    assert apply(lambda c: J.mappable(J.parse(c)), list(cases)) == list(cases.values())


def test_organisation(apply):
    def org(en, fr):
        return json.dumps([{"organisation": {"en": en, "fr": fr}}])

    cases = {
        org("Gov; Org; x", "Gouv; Orga"): ("Org", "Orga"),
        org("Gov; Org", None): ("Org", None),
        org(5, "only"): (None, None),
        '[{}, null, {"organisation": {"en": "a;b"}}]': ("b", None),
        '[{"other": 1}, {"organisation": {"en": "a;b"}}]': (None, None),
        '[{"organisation": "a;b"}]': (None, None),
        '{"organisation": {"en": "a;b"}}': (None, None),
        "[null]": (None, None),
        "nonsense": (None, None),
        None: (None, None),
    }
    got = apply(lambda c: J.organisation(J.parse(c)), list(cases))
    assert [tuple(g) for g in got] == list(cases.values())


def test_choose_organisation(spark):
    rows = [
        ("Gov; Cited", None, "Gov; Contact", "Gouv; Contact fr"),
        (None, None, "Gov; Contact", "Gouv; Contact fr"),
        ("Gov;", "Gouv;", "Gov; Contact", None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    from textprep_spark.functions.text import second_segment as s

    cited = F.struct(s(F.col("a")).alias("en"), s(F.col("b")).alias("fr"))
    contact = F.struct(s(F.col("c")).alias("en"), s(F.col("d")).alias("fr"))
    got = [tuple(r[0]) for r in df.select(J.choose_organisation(cited, contact)).collect()]
    assert got == [("Cited", None), ("Contact", "Contact fr"), ("Contact", None), (None, None)]


def test_topics_to_themes(spark):
    bins = {"topic1": "t1", "topic2": "t2", "other1": "t1", "none": ""}
    rows = [(["TOPIC1", "Topic2 "],), (["topic2", "topic1", "other1"],), (["x", "none"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = [r[0] for r in df.select(TH.topics_to_themes(F.col("t"), bins)).collect()]
    assert got == [["t1", "t2"], ["t1", "t2"], [], [], []]
    assert len(fv.THEME_OF_TOPIC) == 21
    assert [r[0] for r in df.select(TH.topics_to_themes(F.col("t"), {})).collect()] == [[]] * 5


def test_append_tags(spark):
    rows = [(["a"], ["legal", "other"]), (["legal"], ["legal", ""]), (None, ["legal"]), (["a"], None)]
    df = spark.createDataFrame(rows, "have array<string>, tags array<string>")
    some = [r[0] for r in df.select(TH.append_tags(F.col("have"), F.col("tags"), ["legal"])).collect()]
    assert some == [["a", "legal"], ["legal"], ["legal"], ["a"]]
    every = [r[0] for r in df.select(TH.append_tags(F.col("have"), F.col("tags"))).collect()]
    assert every == [["a", "legal", "other"], ["legal"], ["legal"], ["a"]]


def test_foundational(spark, apply):
    cases = {
        '["  foundational  "]': "true",
        '["x", "FoundaTional"]': "true",
        '[null, "other"]': "false",
        '"foundational"': "true",
        " Foundational ": "true",
        '["foundational"] x': "false",
        "[]": "false",
        "invalid json": "false",
        '{"a": "foundational"}': "false",
        None: "false",
    }
    assert apply(TH.foundational_text, list(cases)) == list(cases.values())
    df = spark.createDataFrame([(["x", " Foundational"],), ([None, "x"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(TH.foundational(F.col("t"))).collect()] == ["true", "false", "false"]


# --- document texts ---------------------------------------------------------------------------------


@pytest.fixture
def products(spark):
    columns = ", ".join(
        f"{P}{part}_{lang} string" for lang in ("en", "fr") for part in ("title", "description_normalized", "keywords")
    )
    rows = [
        ("Product A", "Text A", "k1, k2", "Produit A", "Texte A", "m1"),
        ("Product B", None, "k3", None, "Texte B", None),
    ]
    return spark.createDataFrame(rows, columns)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_sequential_text(products):
    assert column(products, record_text(products)) == [
        "Product A\nkeywords:k1, k2\nText A\nProduit A\nmots-clés associés:m1\nTexte A",
        "Product B\nkeywords:k3\n\n\nmots-clés associés:\nTexte B",
    ]


def test_parallel_text(products):
    got = column(products, record_text(products, layout=PARALLEL))
    assert got[0] == "Product A\nProduit A\nkeywords:k1, k2\nmots-clés associés:m1\nText A\nTexte A"


def test_one_language_and_lists(products):
    listed = products.withColumn(P + "keywords_en", F.array(F.lit("a"), F.lit("b")))
    assert column(listed, record_text(listed, ["en"], ["kw="])) == ["Product A\nkw=a, b\nText A", "Product B\nkw=a, b\n"]
    numbers = products.withColumn(P + "keywords_en", F.lit(5))
    assert column(numbers, record_text(numbers, ["en"]))[0] == "Product A\nkeywords:\nText A"


def test_text_arguments(products):
    assert column(products, record_text(products.drop(P + "title_fr"))) == ["", ""]
    with pytest.raises(ValueError):
        record_text(products, ["en"], ["a", "b"])
    with pytest.raises(ValueError):
        record_text(products, layout="sideways")


def test_plain_text(spark):
    columns = ", ".join(f"{P}{part}_fr string" for part in ("title", "description", "keywords"))
    df = spark.createDataFrame([("T", None, "a ,b")], columns)
    assert column(df, plain_record_text("fr")) == ["T\nNone\nkeywords:a ,b"]


def test_normalize_columns(spark):
    body = (
        "Description B with https://www.example.com/x?y and a@b.org that also has a table!!!\n"
        "+------+------+\n| Col1\\ | Col2\\ |\n| \\ | \\ |\n+------+------+\nEnd   of it.\n\n\nMore "
    )
    df = spark.createDataFrame([("Plain.",), (body,), (None,)], "description_en string")
    out = normalize_columns(df, ["description_en"], {"en": LanguageConfig()})
    assert out.columns == ["description_en", "description_normalized_en"]
    rows = out.collect()
    assert rows[1]["description_en"] == body
    assert [r["description_normalized_en"] for r in rows] == [
        "Plain.",
        "Description B with www.example.com [url] and [email] that also has a table!\n"
        "| Col1 | Col2 |\nEnd of it.\nMore",
        None,
    ]
    both = df.withColumn("description_fr", F.lit("x"))
    assert "description_normalized_fr" in normalize_columns(both, ["description"]).columns


# --- cleaning -----------------------------------------------------------------------------------------


def test_required_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cleaning.require_columns(df, ["c", "a"]).columns == ["c", "a"]
    with pytest.raises(ValueError, match="x.*y"):
        cleaning.require_columns(df, ["x", "a", "y"])


def test_placeholders_sources_lists(spark):
    na = fv.NOT_AVAILABLE
    df = spark.createDataFrame([(na, fv.LEGACY_SOURCE), (na + " ", None), (None, "x")], "d string, s string")
    assert column(df, cleaning.placeholder_to_null(F.col("d"), [na])) == [None, na + " ", None]
    assert column(df, cleaning.source_or_default(F.col("s"))) == [fv.DEFAULT_SOURCE, fv.DEFAULT_SOURCE, "x"]
    lists = spark.createDataFrame([(["a "],), (None,)], "k array<string>")
    assert column(lists, cleaning.as_list(lists, "k")) == [["a "], []]
    ints = spark.createDataFrame([(1,)], "k int")
    assert column(ints, cleaning.as_list(ints, "k")) == [[]]


def test_temporal_extent(spark):
    begin, end = P + "temporalExtent_begin", P + "temporalExtent_end"
    df = spark.createDataFrame([("2001", "Present"), (fv.NOT_AVAILABLE, "2002")], f"{begin} string, {end} string")
    out = cleaning.temporal_extent(df)
    assert out.columns == ["temporalExtent"]
    assert [tuple(r[0]) for r in out.collect()] == [("2001", None), (None, "2002")]


def test_row_filters(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "c", float("nan"))], "i int, t string, x double")
    assert column(cleaning.drop_missing(df, ["t"]), "i") == [1, 3]
    assert column(cleaning.drop_missing(df, ["t", "x"]), "i") == [1]
    assert column(cleaning.first_rows(df, 2, F.desc("i")), "i") == [3, 2]

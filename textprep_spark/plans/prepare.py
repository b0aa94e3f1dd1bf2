"""The two record preparation plans.

Both are one lazy plan per call: scan, clean, normalise, two duplicate-removal shuffles, document
texts. Only the columns a step needs travel through the shuffles: duplicates are found by hashes
of the document texts, and the four texts are put together again behind the last shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions import jsoncols, themes
from textprep_spark.functions.documents import PARALLEL, SEQUENTIAL, record_text
from textprep_spark.functions.text import LanguageConfig
from textprep_spark.operators.cleaning import (
    clean_dates,
    drop_eo,
    drop_missing,
    lists_from_text,
    require_columns,
    source_or_default,
    temporal_extent,
)
from textprep_spark.operators.dedup import content_key, keep_first
from textprep_spark.operators.enrich import Lookup, enrich
from textprep_spark.operators.normalize import normalize_columns

KEYWORDS = [fv.P + "keywords_en", fv.P + "keywords_fr"]


def document_texts(df: DataFrame) -> DataFrame:
    """Add ``text_en``, ``text_fr``, ``text_seq`` and ``text_para``."""
    return df.withColumns(
        {
            "text_en": record_text(df, ["en"]),
            "text_fr": record_text(df, ["fr"]),
            "text_seq": record_text(df, ["en", "fr"], layout=SEQUENTIAL),
            "text_para": record_text(df, ["en", "fr"], layout=PARALLEL),
        }
    )


def _distinct_texts(df: DataFrame) -> DataFrame:
    """Drop records without text, then repeats of the English and of the French text.

    Of equal texts the record with the smallest id stays; records alike in id as well are told
    apart by their other columns, so the outcome does not depend on the layout of the data.
    """
    texts = {"__en": record_text(df, ["en"]), "__fr": record_text(df, ["fr"])}
    keyed = drop_missing(df.withColumns(texts), list(texts))
    keys = {name: content_key(F.col(name)) for name in texts}
    keyed = keyed.withColumns({**keys, "__tie": F.xxhash64(*df.columns)})
    order = [F.col(c) for c in (fv.ID, *texts, "__tie")]
    for name in texts:
        keyed = keep_first(keyed, name, order)
    return keyed.drop(*texts, "__tie")


def distinct_records(
    df: DataFrame,
    languages: Mapping[str, LanguageConfig] | None = None,
    keep_eo: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """Keyword lists, normalised descriptions, duplicate removal; no document texts yet.

    Earth-observation records go last, after duplicate removal: one of them may stand for a
    group of equal texts, and then the whole group goes.
    """
    df = lists_from_text(df, KEYWORDS)
    df = normalize_columns(df, [fv.P + "description"], languages, observation)
    df = _distinct_texts(df)
    return df if keep_eo else drop_eo(df)


def prepare_text(
    records: DataFrame, keep_eo: bool = False, observation: Observation | None = None
) -> DataFrame:
    """Text preparation: 8 input columns, 6 added ones."""
    df = require_columns(records, fv.TEXT_COLUMNS)
    return document_texts(distinct_records(df, keep_eo=keep_eo, observation=observation))


def record_features(
    records: DataFrame, theme_of_topic: Mapping[str, str] | None = None
) -> DataFrame:
    """Cleaned columns and the features taken from JSON columns and topics; no joins.

    Sets the session to accept repeated keys in JSON objects.
    """
    jsoncols.accept_repeated_keys(records.sparkSession)
    df = require_columns(records, fv.FULL_COLUMNS)
    df = clean_dates(df)
    source = fv.P + "sourceSystemName"
    df = df.withColumn(source, source_or_default(F.col(source)))
    df = lists_from_text(df, [fv.P + "topicCategory", *KEYWORDS])
    df = temporal_extent(df)
    # The parsed columns are projections of their own, so that each text is parsed once however
    # many features read it.
    raw = {"__options": "options", "__cited": "cited", "__contact": "contact"}
    df = df.withColumns({v: jsoncols.wrap(F.col(fv.P + c)) for v, c in raw.items()})
    df = df.withColumns({v: jsoncols.unwrap(F.col(v)) for v in raw})
    df = df.withColumns(
        {
            "__cited": jsoncols.organisation(F.col("__cited")),
            "__contact": jsoncols.organisation(F.col("__contact")),
        }
    )
    return df.withColumns(
        {
            fv.P + "type": jsoncols.option_descriptions(F.col("__options")),
            fv.P + "org": jsoncols.choose_organisation(F.col("__cited"), F.col("__contact")),
            fv.P + "mappable": jsoncols.mappable(F.col("__options")),
            fv.P + "geo_theme": themes.topics_to_themes(
                F.col(fv.P + "topicCategory"), theme_of_topic
            ),
        }
    ).drop(*raw)


def prepare_full(
    records: DataFrame,
    theme_lookup: DataFrame | None = None,
    foundational_lookup: DataFrame | None = None,
    keep_eo: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """Full preparation: 24 input columns, features, lookup tags, then the text steps.

    Lookups have ``(uuid, tag)``; a missing or empty one adds nothing.
    """
    df = record_features(records)
    lookups: Sequence[Lookup] = [
        (lookup, allowed)
        for lookup, allowed in (
            (theme_lookup, fv.THEME_TAGS_ALLOWED),
            (foundational_lookup, None),
        )
        if lookup is not None
    ]
    df = enrich(df, lookups)
    df = df.withColumn(
        fv.P + "foundational", themes.foundational(F.col(fv.P + "geo_theme"))
    )
    return document_texts(distinct_records(df, keep_eo=keep_eo, observation=observation))

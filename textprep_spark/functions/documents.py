"""Assembling one document text per record from title, keywords and description."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep_spark import fixed_values as fv

logger = logging.getLogger(__name__)

SEQUENTIAL = "sequential"
PARALLEL = "parallel"


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _keywords(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return _or_empty(name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.col(name), ", "), F.lit(""))
    return F.lit("")


def record_text(
    df: DataFrame,
    languages: Sequence[str] = ("en", "fr"),
    keyword_prefixes: Sequence[str] | None = None,
    layout: str = SEQUENTIAL,
) -> Column:
    """Document text of the records in ``df``.

    ``sequential`` writes one block (title, keywords, description) per language; ``parallel``
    writes all titles, then all keyword lines, then all descriptions. When a needed column is
    absent the text is empty for every row.
    """
    if keyword_prefixes is None:
        keyword_prefixes = [fv.KEYWORD_PREFIX[lang] for lang in languages]
    if len(keyword_prefixes) != len(languages):
        raise ValueError("keyword_prefixes and languages differ in length")

    columns = {
        lang: (
            f"{fv.P}title_{lang}",
            f"{fv.P}keywords_{lang}",
            f"{fv.P}description_normalized_{lang}",
        )
        for lang in languages
    }
    absent = [c for names in columns.values() for c in names if c not in df.columns]
    if absent:
        logger.warning("no document text: columns %s are absent", absent)
        return F.lit("")

    titles = [_or_empty(columns[lang][0]) for lang in languages]
    keywords = [
        F.concat(F.lit(prefix), _keywords(df, columns[lang][1]))
        for lang, prefix in zip(languages, keyword_prefixes)
    ]
    bodies = [_or_empty(columns[lang][2]) for lang in languages]
    if layout == SEQUENTIAL:
        pieces = [piece for block in zip(titles, keywords, bodies) for piece in block]
    elif layout == PARALLEL:
        pieces = titles + keywords + bodies
    else:
        raise ValueError(f"unknown layout {layout!r}; use {SEQUENTIAL!r} or {PARALLEL!r}")
    return F.concat_ws("\n", *pieces)


def plain_record_text(language: str = "en") -> Column:
    """Earlier document text: title, raw description, raw keywords; nulls print as ``None``.

    The keyword label is the same in every language.
    """

    def shown(part: str) -> Column:
        return F.coalesce(F.col(f"{fv.P}{part}_{language}"), F.lit("None"))

    return F.concat(
        shown("title"),
        F.lit("\n"),
        shown("description"),
        F.lit("\n" + fv.KEYWORD_PREFIX["en"]),
        shown("keywords"),
    )

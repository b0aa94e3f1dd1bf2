"""Theme lists: binning topics, appending tags, the foundational flag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions import jsoncols
from textprep_spark.functions.text import strip


def _no_items() -> Column:
    return F.array().cast("array<string>")


def topics_to_themes(topics: Column, theme_of_topic: Mapping[str, str] | None = None) -> Column:
    """Sorted distinct themes of an array of topics; unknown topics are dropped."""
    bins = fv.THEME_OF_TOPIC if theme_of_topic is None else theme_of_topic
    known = [(k, v) for k, v in bins.items() if v]
    if not known:
        return _no_items()
    lookup = F.create_map(*[F.lit(x) for pair in known for x in pair])
    themes = F.transform(topics, lambda t: F.try_element_at(lookup, strip(F.lower(t))))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(themes))), _no_items())


def append_tags(existing: Column, tags: Column, allowed: Sequence[str] | None = None) -> Column:
    """``existing`` followed by those ``tags`` that are non-empty, allowed and not in it yet."""
    usable = F.filter(F.coalesce(tags, _no_items()), lambda t: t.isNotNull() & (t != ""))
    if allowed is not None:
        usable = F.filter(usable, lambda t: t.isin(list(allowed)))
    have = F.coalesce(existing, _no_items())
    return F.concat(have, F.array_except(usable, have))


def _flag(hit: Column) -> Column:
    return F.when(hit, F.lit("true")).otherwise(F.lit("false"))


def foundational(themes: Column) -> Column:
    """``'true'`` when an array of themes holds the foundational tag (any case, any spacing)."""
    return _flag(F.exists(themes, lambda t: strip(F.lower(t)) == fv.FOUNDATIONAL))


def foundational_text(themes: Column) -> Column:
    """The same for text that is a JSON array, a JSON string, or the bare tag."""

    def is_tag(c: Column) -> Column:
        return strip(F.lower(c)) == fv.FOUNDATIONAL

    parsed = jsoncols.parse(themes)
    listed = F.exists(
        F.try_variant_get(parsed, "$", "array<variant>"),
        lambda v: is_tag(F.try_variant_get(v, "$", "string")),
    )
    single = is_tag(F.try_variant_get(parsed, "$", "string"))
    return _flag(F.when(parsed.isNull(), is_tag(themes)).otherwise(F.coalesce(listed, single)))

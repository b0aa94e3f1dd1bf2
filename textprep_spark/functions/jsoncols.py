"""Features of JSON text columns that hold an object or an array of objects.

``parse`` turns the text into a VARIANT once; the other functions read that VARIANT. Keep the
parsed value in its own column when several features come from it, so it is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.functions.text import second_segment, strip

# Marks the end of the wrapped document. The parser stops at the end of the first complete
# value, so text with anything after its value ("[] x") would pass; inside a wrapper with a
# marker behind it, it cannot.
_END = "\u0001end"


def accept_repeated_keys(spark: SparkSession) -> None:
    """Let the session's JSON parser take an object that repeats a key; the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def wrap(c: Column) -> Column:
    """``[<text>, <marker>]`` as a VARIANT, null when that is not valid JSON."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"\\u0001end"]')))


def unwrap(w: Column) -> Column:
    """The document inside a wrapped VARIANT, null unless the text was exactly one value."""
    complete = F.try_variant_get(w, "$[1]", "string") == F.lit(_END)
    return F.when(complete, F.try_variant_get(w, "$[0]", "variant"))


def parse(c: Column) -> Column:
    """Strictly parsed JSON text as a VARIANT; null for null or malformed text."""
    return unwrap(wrap(c))


def _fields(v: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _is_object(v: Column) -> Column:
    return _fields(v).isNotNull()


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _text(v: Column) -> Column:
    """A string value; null for other types, which a plain cast would turn into text."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _objects(v: Column) -> Column:
    """The objects of an array, or the one object itself; null when there is neither."""
    return F.coalesce(F.filter(_array(v), _is_object), F.when(_is_object(v), F.array(v)))


def option_descriptions(v: Column, language: str = "en") -> Column:
    """Sorted distinct description heads (text before the first ``;``) of the options.

    One description that is present but not an object empties the whole result.
    """
    descriptions = F.filter(
        F.transform(_objects(v), lambda o: _member(o, "description")), lambda d: d.isNotNull()
    )
    broken = F.exists(descriptions, lambda d: ~_is_object(d))
    heads = F.transform(
        F.transform(descriptions, lambda d: _text(_member(d, language))),
        lambda t: strip(F.substring_index(t, ";", 1)),
    )
    found = F.array_sort(F.array_distinct(F.array_compact(heads)))
    nothing = F.array().cast("array<string>")
    return F.when(broken, nothing).otherwise(F.coalesce(found, nothing))


def mappable(v: Column) -> Column:
    """``'true'`` when an option's protocol names a map service, else ``'false'``.

    One protocol that is present but not a string makes the record ``'false'``.
    """
    protocols = F.filter(
        F.transform(_objects(v), lambda o: _member(o, "protocol")), lambda p: p.isNotNull()
    )
    broken = F.exists(protocols, lambda p: F.schema_of_variant(p) != "STRING")

    def names_service(p: Column) -> Column:
        name = F.lower(F.try_variant_get(p, "$", "string"))
        hit = F.lit(False)
        for word in fv.MAPPABLE_PROTOCOLS:
            hit = hit | F.contains(name, F.lit(word))
        return hit

    yes = ~broken & F.exists(protocols, names_service)
    return F.when(yes, F.lit("true")).otherwise(F.lit("false"))


def organisation(v: Column) -> Column:
    """``struct(en, fr)``: second segment of the first contact's organisation names."""
    contacts = F.filter(_array(v), lambda o: F.cardinality(_fields(o)) > 0)
    org = _member(F.get(contacts, F.lit(0)), "organisation")
    return F.struct(
        second_segment(_text(_member(org, "en"))).alias("en"),
        second_segment(_text(_member(org, "fr"))).alias("fr"),
    )


def choose_organisation(cited: Column, contact: Column) -> Column:
    """``cited`` as a whole when it has a non-empty name in either language, else ``contact``."""
    named = F.coalesce(cited["en"] != "", F.lit(False)) | F.coalesce(
        cited["fr"] != "", F.lit(False)
    )
    return F.when(named, cited).otherwise(contact)

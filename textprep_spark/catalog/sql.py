"""Building blocks of the checking SQL: the same rules written for another engine."""

from __future__ import annotations

from textprep_spark import fixed_values as fv
from textprep_spark.catalog.records import (
    FOUNDATIONAL_LOOKUP_SQL,
    RECORDS_SQL,
    THEME_LOOKUP_SQL,
)

_WS = "(" + "||".join(f"chr({ord(c)})" for c in fv.WHITESPACE) + ")"
_RE_WS = "".join(rf"\x{{{ord(c):x}}}" for c in fv.WHITESPACE)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def _sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {replacement}, 'g')"


# fixed patterns, as this engine writes them


def emails(x: str) -> str:
    return _sub(x, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "'[email]'")


def urls(x: str) -> str:
    pattern = (
        r"(?:https?://|www\.|ftp\.)((?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,63})(?::[0-9]+)?"
        rf"(?:[/?#][^{_RE_WS}()]*)?"
    )
    return _sub(x, pattern, r"'\1 [url]'")


def tables(x: str) -> str:
    x = _sub(x, rf"[{_RE_WS}]*\+-+(?:\+-+)?\+[{_RE_WS}]*", "chr(10)")
    x = _sub(x, r"\\ *\|", "' |'")
    return _sub(x, r"\n\|[ |]*\|\n", "chr(10)")


def section(x: str, header: str) -> str:
    return strip(f"split_part({x}, {quoted(header)}, 1)")


def punctuation(x: str) -> str:
    for mark in fv.COLLAPSIBLE:
        x = f"regexp_replace({x}, {quoted(f'[{chr(92)}{mark}]{{2,}}')}, {quoted(mark)}, 'g')"
    return strip(x)


def whitespace(x: str) -> str:
    x = _sub(x, " {2,}", "' '")
    x = _sub(x, r"\n{2,}", "chr(10)")
    return strip(_sub(x, r" *\n +\n", "chr(10)"))


def _chars(text: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in text)


def symbol(x: str, what: str, word: str) -> str:
    return f"replace({x}, {_chars(what)}, {_chars(word)})"


def steps(lang: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = [
        ("cut_section", lambda x: section(x, fv.SECTION_HEADER[lang])),
        ("mask_urls", urls),
        ("mask_emails", emails),
    ]
    for what, word in fv.SYMBOL_WORDS[lang]:
        out.append((f"symbol_{what}", lambda x, a=what, b=word: symbol(x, a, b)))
    out += [
        ("tables_to_text", tables),
        ("collapse_punctuation", punctuation),
        ("squeeze_whitespace", whitespace),
    ]
    return out


def normalized(x: str, lang: str) -> str:
    for _, step in steps(lang):
        x = step(x)
    return x


def items(x: str) -> str:
    cut = f"list_transform(string_split({x}, ','), lambda i: {strip('i')})"
    return f"coalesce({cut}, cast([] as varchar[]))"


def second_segment(x: str) -> str:
    return f"case when len(string_split({x}, ';')) >= 2 then {strip(f'split_part({x}, {quoted(chr(59))}, 2)')} end"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def json_options(x: str) -> str:
    """Array of the JSON objects in an object-or-array column; null when it is neither."""
    return (
        f"case when json_valid({x}) then case json_type({x}) "
        f"when 'ARRAY' then list_filter(from_json({x}, '[\"JSON\"]'), lambda o: json_type(o) = 'OBJECT') "
        f"when 'OBJECT' then [{x}::json] end end"
    )


def option_descriptions(x: str) -> str:
    o = json_options(x)
    head = strip("split_part(o ->> '$.description.en', ';', 1)")
    return f"""case when coalesce(len(list_filter({o}, lambda o:
        json_type(o, '$.description') is not null and json_type(o, '$.description') <> 'OBJECT')), 0) > 0
      then cast([] as varchar[])
      else coalesce(list_sort(list_distinct(list_transform(list_filter({o}, lambda o:
        json_type(o, '$.description.en') = 'VARCHAR'), lambda o: {head}))), cast([] as varchar[])) end"""


def mappable(x: str) -> str:
    o = json_options(x)
    hit = " or ".join(f"contains(lower(o ->> '$.protocol'), {quoted(w)})" for w in fv.MAPPABLE_PROTOCOLS)
    return f"""case when coalesce(len(list_filter({o}, lambda o:
        json_type(o, '$.protocol') is not null and json_type(o, '$.protocol') <> 'VARCHAR')), 0) = 0
       and coalesce(len(list_filter({o}, lambda o: {hit})), 0) > 0
      then 'true' else 'false' end"""


def _org_part(x: str, lang: str) -> str:
    first = f"""list_filter(case when json_valid({x}) and json_type({x}) = 'ARRAY'
        then from_json({x}, '["JSON"]') end,
        lambda o: json_type(o) = 'OBJECT' and len(json_keys(o)) > 0)[1]"""
    name = f"""case when json_type({first}, '$.organisation.{lang}') = 'VARCHAR'
        then {first} ->> '$.organisation.{lang}' end"""
    return second_segment(f"({name})")


def organisation(cited: str, contact: str, lang: str) -> str:
    use_cited = f"coalesce({_org_part(cited, 'en')}, '') <> '' or coalesce({_org_part(cited, 'fr')}, '') <> ''"
    return f"case when {use_cited} then {_org_part(cited, lang)} else {_org_part(contact, lang)} end"


_THEME_VALUES = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in fv.THEME_OF_TOPIC.items())
BINS_CTE = f"bins as (select * from (values {_THEME_VALUES}) t(topic, theme))"
RECORDS_CTE = f"records as ({RECORDS_SQL})"
LOOKUPS_CTE = f"""theme_lookup as ({THEME_LOOKUP_SQL}),
foundational_lookup as ({FOUNDATIONAL_LOOKUP_SQL}),
theme_tags as (select uuid, list_sort(list(distinct tag)) as tags from theme_lookup
  where tag in ({", ".join(quoted(t) for t in fv.THEME_TAGS_ALLOWED)}) group by uuid),
foundational_tags as (select uuid, list_sort(list(distinct tag)) as tags from foundational_lookup
  where tag <> '' group by uuid)"""
THEMES_CTE = f"""topics as (select {fv.ID} as id, unnest({items(fv.P + 'topicCategory')}) as topic from records),
binned as (select id, list_sort(list(distinct theme)) as themes
  from topics join bins on bins.topic = {strip('lower(topics.topic)')} group by id),
themed as (select r.{fv.ID} as id, coalesce(b.themes, cast([] as varchar[])) as themes
  from records r left join binned b on b.id = r.{fv.ID})"""


def _appended(have: str, tags: str) -> str:
    return f"list_concat({have}, list_filter(coalesce({tags}, cast([] as varchar[])), lambda t: not list_contains({have}, t)))"


ENRICHED_CTE = f"""step1 as (select t.id, {_appended('t.themes', 'k.tags')} as themes
  from themed t left join theme_tags k on k.uuid = t.id),
enriched as (select t.id, {_appended('t.themes', 'k.tags')} as themes
  from step1 t left join foundational_tags k on k.uuid = t.id)"""


def _keyword_line(lang: str) -> str:
    return f"{quoted(fv.KEYWORD_PREFIX[lang])} || array_to_string({items(f'{fv.P}keywords_{lang}')}, ', ')"


def document_text(langs: list[str], parallel: bool = False) -> str:
    """Document text over a row that has ``n_en`` and ``n_fr``, the normalised descriptions."""
    title = {x: f"coalesce({fv.P}title_{x}, '')" for x in langs}
    body = {x: f"coalesce(n_{x}, '')" for x in langs}
    if parallel:
        parts = [title[x] for x in langs] + [_keyword_line(x) for x in langs] + [body[x] for x in langs]
    else:
        parts = [p for x in langs for p in (title[x], _keyword_line(x), body[x])]
    return " || chr(10) || ".join(parts)


def texts_cte() -> str:
    return f"""normal as (select *, {normalized(fv.P + 'description_en', 'en')} as n_en,
  {normalized(fv.P + 'description_fr', 'fr')} as n_fr from records),
texts as (select *, {document_text(['en'])} as text_en, {document_text(['fr'])} as text_fr,
  {document_text(['en', 'fr'])} as text_seq, {document_text(['en', 'fr'], True)} as text_para
  from normal),
once as (select * from texts
  qualify row_number() over (partition by text_en order by {fv.ID}) = 1),
twice as (select * from once
  qualify row_number() over (partition by text_fr order by {fv.ID}) = 1),
prepared as (select * from twice where {fv.EO_COLLECTION} is null)"""

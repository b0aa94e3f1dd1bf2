"""The registered queries: what each computes in Spark, and the SQL that checks it.

Every query reads whole tables and whole texts. Arrays come out as joined text and structs as
columns so that results compare as plain values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv
from textprep_spark.catalog import sql as Q
from textprep_spark.catalog.records import (
    documents,
    foundational_lookup,
    label_means,
    table,
    theme_lookup,
)
from textprep_spark.catalog.records import records as read_given_records
from textprep_spark.functions import jsoncols, sentences, text, themes, vectors
from textprep_spark.functions.documents import PARALLEL, plain_record_text, record_text
from textprep_spark.operators import cleaning, metrics
from textprep_spark.operators.boundaries import learn_splitter
from textprep_spark.operators.dedup import deduplicate
from textprep_spark.operators.enrich import enrich
from textprep_spark.operators.infer import embed_texts, generate_questions
from textprep_spark.operators.normalize import change_report, normalize_columns
from textprep_spark.operators.pairs import adjacent_pairs, text_halves
from textprep_spark.operators.pruned_search import pruned_top_k
from textprep_spark.operators.search import keyword_first, top_k
from textprep_spark.operators.split import assign_split
from textprep_spark.operators.substring_index import build_index, first_documents
from textprep_spark.plans.evaluate import compare_listed, evaluate_search, search
from textprep_spark.plans.prepare import prepare_full, prepare_text
from textprep_spark.sources.readers import (
    embedding_source,
    lookup_table,
    read_records,
    text_list,
    union_by_name,
    with_file_position,
)
from textprep_spark.sources.writers import stage

Query = Callable[[SparkSession, str], DataFrame]
P = fv.P


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


CATALOG: dict[str, Registered] = {}


PARTS = 32  # the given documents are one row group, which one task would work on alone


def records(spark: SparkSession, d: str) -> DataFrame:
    return read_given_records(spark, d, PARTS)


def _query(sql: str | None = None, name: str | None = None):
    def register(run: Query) -> Query:
        CATALOG[name or run.__name__] = Registered(run, sql)
        return run

    return register


def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def _joined(name: str | Column, sep: str = "|") -> Column:
    return F.array_join(name, sep)


EN, FR = P + "description_en", P + "description_fr"
REC = _with(Q.RECORDS_CTE)

# --- text functions ------------------------------------------------------------------------------


def _on_records(fn: Callable[[Column], Column], alias: str) -> Query:
    return lambda spark, d: records(spark, d).select(fv.ID, fn(F.col(EN)).alias(alias))


@_query(
    REC
    + f"select {fv.ID}, {Q.normalized(EN, 'en')} as {P}description_normalized_en,"
    + f" {Q.normalized(FR, 'fr')} as {P}description_normalized_fr from records"
)
def normalize_description(spark: SparkSession, d: str) -> DataFrame:
    out = normalize_columns(records(spark, d).select(fv.ID, EN, FR), [P + "description"])
    return out.select(fv.ID, P + "description_normalized_en", P + "description_normalized_fr")


@_query(f"select doc_id, {Q.emails('text')} as masked from documents")
def mask_emails(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        "doc_id", text.mask_emails(F.col("text")).alias("masked")
    )


@_query(f"select page_id, {Q.urls('url')} as url, {Q.urls('html')} as html from pages")
def mask_urls(spark: SparkSession, d: str) -> DataFrame:
    masked = [text.mask_urls(F.col(c)).alias(c) for c in ("url", "html")]
    return table(spark, d, "pages").select("page_id", *masked)


_query(REC + f"select {fv.ID}, {Q.tables(EN)} as flat from records", "tables_to_text")(
    _on_records(text.tables_to_text, "flat")
)
_query(REC + f"select {fv.ID}, {Q.section(EN, 'References')} as cut from records", "cut_section")(
    _on_records(lambda c: text.cut_section(c, "References"), "cut")
)
_query(REC + f"select {fv.ID}, {Q.whitespace(EN)} as squeezed from records", "squeeze_whitespace")(
    _on_records(text.squeeze_whitespace, "squeezed")
)


@_query(f"select doc_id, {Q.punctuation('text')} as collapsed from documents")
def collapse_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        "doc_id", text.collapse_punctuation(F.col("text")).alias("collapsed")
    )


def _all_symbols(c: Column) -> Column:
    for what, word in fv.SYMBOL_WORDS["en"]:
        c = text.symbol_to_word(c, what, word)
    return c


def _all_symbols_sql(x: str) -> str:
    for what, word in fv.SYMBOL_WORDS["en"]:
        x = Q.symbol(x, what, word)
    return x


_query(REC + f"select {fv.ID}, {_all_symbols_sql(EN)} as worded from records", "symbols_to_words")(
    _on_records(_all_symbols, "worded")
)


def _change_report_sql() -> str:
    names, columns, x = [], [], EN
    for i, (name, step) in enumerate(Q.steps("en")):
        after = step(f"v{i}")
        columns.append((f"v{i + 1}", after))
        names.append(name)
    ctes = [Q.RECORDS_CTE, f"s0 as (select {x} as v0 from records)"]
    for i, (alias, expr) in enumerate(columns):
        ctes.append(f"s{i + 1} as (select *, {expr} as {alias} from s{i})")
    last = f"s{len(columns)}"
    rows = [
        f"select {i + 1} as step_no, {Q.quoted(name)} as step,"
        f" count(*) filter (where v{i} is distinct from v{i + 1}) as changed_rows,"
        f" count(*) filter (where v0 is null) as null_rows from {last}"
        for i, name in enumerate(names)
    ]
    return _with(*ctes) + "\nunion all ".join(rows)


@_query(_change_report_sql(), "change_report")
def _change_report(spark: SparkSession, d: str) -> DataFrame:
    return change_report(records(spark, d), EN, text.DEFAULT_LANGUAGES["en"])


@_query(
    _with(Q.RECORDS_CTE, Q.texts_cte())
    + f"select {fv.ID}, text_en, text_fr, text_seq, text_para from texts",
    "record_text",
)
def _record_text(spark: SparkSession, d: str) -> DataFrame:
    df = records(spark, d).select(*fv.TEXT_COLUMNS)
    df = cleaning.lists_from_text(df, [P + "keywords_en", P + "keywords_fr"])
    df = normalize_columns(df, [P + "description"])
    return df.select(
        fv.ID,
        record_text(df, ["en"]).alias("text_en"),
        record_text(df, ["fr"]).alias("text_fr"),
        record_text(df, ["en", "fr"]).alias("text_seq"),
        record_text(df, ["en", "fr"], layout=PARALLEL).alias("text_para"),
    )


@_query(
    _with(Q.RECORDS_CTE, Q.texts_cte()) + f"select {fv.ID}, text_en, '' as text_fr, '' as text_seq from texts"
)
def record_text_absent(spark: SparkSession, d: str) -> DataFrame:
    """A needed column is absent: the texts that need it are empty, the others as ever."""
    df = records(spark, d).select(*fv.TEXT_COLUMNS).drop(P + "title_fr")
    df = cleaning.lists_from_text(df, [P + "keywords_en", P + "keywords_fr"])
    df = normalize_columns(df, [P + "description"])
    texts = {"text_en": ["en"], "text_fr": ["fr"], "text_seq": ["en", "fr"]}
    return df.select(fv.ID, *[record_text(df, languages).alias(n) for n, languages in texts.items()])


def _plain_sql(lang: str) -> str:
    return (
        f"coalesce({P}title_{lang}, 'None') || chr(10) || coalesce({P}description_{lang}, 'None')"
        f" || chr(10) || 'keywords:' || coalesce({P}keywords_{lang}, 'None')"
    )


@_query(REC + f"select {fv.ID}, {_plain_sql('en')} as text_en, {_plain_sql('fr')} as text_fr from records")
def record_text_plain(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select(
        fv.ID, plain_record_text("en").alias("text_en"), plain_record_text("fr").alias("text_fr")
    )


_OPENED = """case turn % 5 when 0 then '  What are the ' || text when 1 then 'WHAT IS A  ' || text
 when 2 then 'what is the ' || text || ' ' when 3 then 'What is' else text end"""
_OPENINGS_RE = "(?i)^(?:" + "|".join(fv.QUESTION_OPENINGS) + ")"
_CLEANED = f"regexp_replace({Q.strip(_OPENED)}, {Q.quoted(_OPENINGS_RE)}, '')"


@_query(f"select conv_id, turn, {Q.strip(_CLEANED)} as question from conversations")
def clean_question(spark: SparkSession, d: str) -> DataFrame:
    opened = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_OPENED).alias("q"))
    return opened.select("conv_id", "turn", text.clean_question(F.col("q")).alias("question"))


_TOKENS = f"list_filter(regexp_split_to_array(lower(text), '[{Q._RE_WS}]+'), lambda t: t <> '')"


@_query(f"select item_id, array_to_string({_TOKENS}, '|') as tokens from benchmark")
def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        "item_id", _joined(text.keyword_tokens(F.col("text"))).alias("tokens")
    )


_FIRST, _SECOND = P + "cited", P + "contact"


@_query(
    REC
    + f"select {fv.ID}, {Q.second_segment(_FIRST)} as cited, {Q.second_segment(_SECOND)} as contact,"
    + f" {Q.second_segment(EN)} as description from records"
)
def second_segment(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select(
        fv.ID,
        text.second_segment(F.col(_FIRST)).alias("cited"),
        text.second_segment(F.col(_SECOND)).alias("contact"),
        text.second_segment(F.col(EN)).alias("description"),
    )


# --- column clean-up and filters --------------------------------------------------------------

_KW = [P + "keywords_en", P + "keywords_fr", P + "topicCategory"]


@_query(
    REC
    + f"select {fv.ID}, "
    + ", ".join(f"array_to_string({Q.items(c)}, '|') as {c}" for c in _KW)
    + " from records"
)
def keyword_list(spark: SparkSession, d: str) -> DataFrame:
    df = cleaning.lists_from_text(records(spark, d), _KW)
    return df.select(fv.ID, *[_joined(c).alias(c) for c in _KW])


_NA = Q.quoted(fv.NOT_AVAILABLE)


@_query(
    REC
    + f"select {fv.ID}, nullif({P}date_published_date, {_NA}) as published,"
    + f" nullif({P}date_created_date, {_NA}) as created from records"
)
def clean_dates(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_dates(records(spark, d)).select(
        fv.ID,
        F.col(P + "date_published_date").alias("published"),
        F.col(P + "date_created_date").alias("created"),
    )


_SRC = P + "sourceSystemName"
_SRC_SQL = f"coalesce(nullif({_SRC}, '{fv.LEGACY_SOURCE}'), '{fv.DEFAULT_SOURCE}')"


@_query(REC + f"select {fv.ID}, {_SRC_SQL} as source from records")
def source_default(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select(
        fv.ID, cleaning.source_or_default(F.col(_SRC)).alias("source")
    )


def _gone(c: str) -> str:
    return f"case when {c} not in ({_NA}, 'Present') then {c} end"


@_query(
    REC
    + f"select {fv.ID}, {_gone(P + 'temporalExtent_begin')} as extent_begin,"
    + f" {_gone(P + 'temporalExtent_end')} as extent_end from records"
)
def temporal_extent(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.temporal_extent(records(spark, d)).select(
        fv.ID,
        F.col("temporalExtent.begin").alias("extent_begin"),
        F.col("temporalExtent.end").alias("extent_end"),
    )


@_query(
    REC + f"select {fv.ID}, {EN}, {FR} from records where {EN} is not null and {FR} is not null"
)
def drop_missing(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_missing(records(spark, d), [EN, FR]).select(fv.ID, EN, FR)


@_query("select b.item_id, b.text, l.doc_id from benchmark b join labels l on l.doc_id = b.item_id")
def drop_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    items, labels = table(spark, d, "benchmark"), table(spark, d, "labels").select("doc_id")
    queries = items.join(labels, items["item_id"] == labels["doc_id"], "left")
    return cleaning.drop_missing(queries, ["doc_id"]).select("item_id", "text", "doc_id")


@_query(REC + f"select {fv.ID}, {P}title_en from records where {fv.EO_COLLECTION} is null")
def eo_filter(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.drop_eo(records(spark, d)).select(fv.ID, P + "title_en")


@_query("select doc_id, text from documents order by doc_id limit 100")
def sample_limit(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.first_rows(table(spark, d, "documents").select("doc_id", "text"), 100, "doc_id")


# --- JSON columns, themes, enrichment ----------------------------------------------------------

_OPT = P + "options"


def _parsed(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Ids and parsed JSON columns, under the columns' short names."""
    jsoncols.accept_repeated_keys(spark)
    parsed = [jsoncols.parse(F.col(P + name)).alias(name) for name in names]
    return records(spark, d).select(fv.ID, *parsed)


@_query(
    REC + f"select {fv.ID}, array_to_string({Q.option_descriptions(_OPT)}, '|') as kinds from records"
)
def option_descriptions(spark: SparkSession, d: str) -> DataFrame:
    kinds = jsoncols.option_descriptions(F.col("options"))
    return _parsed(spark, d, "options").select(fv.ID, _joined(kinds).alias("kinds"))


@_query(REC + f"select {fv.ID}, {Q.mappable(_OPT)} as mappable from records")
def mappable(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, "options").select(
        fv.ID, jsoncols.mappable(F.col("options")).alias("mappable")
    )


_CITED, _CONTACT = P + "cited", P + "contact"


@_query(
    REC
    + f"select {fv.ID}, {Q.organisation(_CITED, _CONTACT, 'en')} as org_en,"
    + f" {Q.organisation(_CITED, _CONTACT, 'fr')} as org_fr from records"
)
def record_org(spark: SparkSession, d: str) -> DataFrame:
    df = _parsed(spark, d, "cited", "contact").select(
        fv.ID,
        jsoncols.organisation(F.col("cited")).alias("cited"),
        jsoncols.organisation(F.col("contact")).alias("contact"),
    )
    org = jsoncols.choose_organisation(F.col("cited"), F.col("contact"))
    return df.select(fv.ID, org.alias("org")).select(
        fv.ID, F.col("org.en").alias("org_en"), F.col("org.fr").alias("org_fr")
    )


def _themed(spark: SparkSession, d: str) -> DataFrame:
    df = cleaning.lists_from_text(records(spark, d), [P + "topicCategory"])
    topics = themes.topics_to_themes(F.col(P + "topicCategory"))
    return df.select(fv.ID, topics.alias(P + "geo_theme"))


@_query(
    _with(Q.RECORDS_CTE, Q.BINS_CTE, Q.THEMES_CTE)
    + f"select id as {fv.ID}, array_to_string(themes, '|') as themes from themed"
)
def geo_themes(spark: SparkSession, d: str) -> DataFrame:
    return _themed(spark, d).select(fv.ID, _joined(P + "geo_theme").alias("themes"))


def _enriched(spark: SparkSession, d: str, join_hint: str | None = None) -> DataFrame:
    lookups = [
        (theme_lookup(spark, d), fv.THEME_TAGS_ALLOWED),
        (foundational_lookup(spark, d), None),
    ]
    return enrich(_themed(spark, d), lookups, join_hint=join_hint)


_ENRICH_CTES = (Q.RECORDS_CTE, Q.BINS_CTE, Q.LOOKUPS_CTE, Q.THEMES_CTE, Q.ENRICHED_CTE)


@_query(
    _with(*_ENRICH_CTES) + f"select id as {fv.ID}, array_to_string(themes, '|') as themes from enriched"
)
def enrich_themes(spark: SparkSession, d: str) -> DataFrame:
    return _enriched(spark, d).select(fv.ID, _joined(P + "geo_theme").alias("themes"))


@_query(
    _with(*_ENRICH_CTES) + f"select id as {fv.ID}, array_to_string(themes, '|') as themes from enriched"
)
def enrich_themes_shuffled(spark: SparkSession, d: str) -> DataFrame:
    enriched = _enriched(spark, d, "merge")
    return enriched.select(fv.ID, _joined(P + "geo_theme").alias("themes"))


_IS_FOUNDATIONAL = "case when list_contains(themes, 'foundational') then 'true' else 'false' end"


@_query(
    _with(*_ENRICH_CTES)
    + f"select id as {fv.ID}, {_IS_FOUNDATIONAL} as from_list,"
    + f" {_IS_FOUNDATIONAL} as from_text from enriched"
)
def foundational(spark: SparkSession, d: str) -> DataFrame:
    theme = F.col(P + "geo_theme")
    return _enriched(spark, d).select(
        fv.ID,
        themes.foundational(theme).alias("from_list"),
        themes.foundational_text(F.to_json(theme)).alias("from_text"),
    )


# --- whole-frame operators -----------------------------------------------------------------------


@_query("select * from documents")
def load_records(spark: SparkSession, d: str) -> DataFrame:
    return read_records(spark, d, pattern="documents.parquet*")


@_query("""select vec_id as doc_id, len(embedding)::integer as length,
 round(list_sum(embedding::double[]), 4) as total from embeddings""")
def embedding_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as JSON text and read back."""
    written = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.to_json("embedding").alias("vector")
    )
    read = embedding_source(written, "id", "vector")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b)
    return read.select("doc_id", F.size("embedding").alias("length"), F.round(total, 4).alias("total"))


@_query("select doc_id::varchar as uuid, 'q' || quality as tag from labels")
def typed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Labels as an export with typed values, unwrapped."""
    labels = table(spark, d, "labels")

    def typed(c):
        return F.struct(c.alias("S"))

    items = labels.select(
        typed(F.col("doc_id").cast("string")).alias("uuid"),
        typed(F.concat(F.lit("q"), "quality")).alias("tag"),
    )
    return lookup_table(items)


@_query(
    """select doc_id, text, lang, source from documents
union all by name select item_id, text from benchmark"""
)
def union_records(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "documents").drop("n_chars")
    return union_by_name([first, table(spark, d, "benchmark")])


@_query(
    """with once as (select * from documents
  qualify row_number() over (partition by text order by doc_id) = 1)
select * from once qualify row_number() over (partition by n_chars order by doc_id) = 1"""
)
def dedup_text(spark: SparkSession, d: str) -> DataFrame:
    return deduplicate(table(spark, d, "documents"), ["text", "n_chars"], ["doc_id"])


@_query(
    """with numbered as (select *, row_number() over () as pos from documents),
once as (select * from numbered qualify row_number() over (partition by text order by pos) = 1)
select * exclude (pos) from once qualify row_number() over (partition by n_chars order by pos) = 1"""
)
def dedup_in_file_order(spark: SparkSession, d: str) -> DataFrame:
    rows = with_file_position(table(spark, d, "documents"))
    return deduplicate(rows, ["text", "n_chars"], ["position"]).drop("position")


def _split_sql(rows: str, key: str, columns: str) -> str:
    return f"""ordered as (select {columns}, row_number() over (order by md5('42|' || {key})) - 1 as pos,
  cast(ceil(count(*) over () * 0.1) as bigint) as held from {rows})
select {columns}, case when pos < (held + 1) // 2 then 'test' when pos < held then 'eval'
  else 'train' end as split from ordered"""


@_query("with " + _split_sql("documents", "doc_id", "doc_id, lang"))
def split_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return assign_split(rows, 0.1, 42, ["doc_id"])


@_query("""with n as (select count(*) as n from documents),
sizes as (select n, ceil(0.1 * n)::bigint as held from n),
parts as (select n, held, ceil(held * 0.5)::bigint as test from sizes)
select 'test' as split, test as rows from parts union all
select 'eval', held - test from parts union all select 'train', n - held from parts""")
def split_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Set sizes where a few values identify all rows."""
    rows = table(spark, d, "documents").select("lang")
    assigned = assign_split(rows, 0.1, 42, ["lang"])
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


_TEXT_OUT = "text_en, text_fr, text_seq, text_para"


@_query(
    _with(Q.RECORDS_CTE, Q.texts_cte())
    + f"select {fv.ID}, n_en as normalized_en, n_fr as normalized_fr, {_TEXT_OUT},"
    + f" array_to_string({Q.items(P + 'keywords_en')}, '|') as keywords_en from prepared",
    "prepare_text",
)
def _prepare_text(spark: SparkSession, d: str) -> DataFrame:
    return prepare_text(records(spark, d)).select(
        fv.ID,
        F.col(P + "description_normalized_en").alias("normalized_en"),
        F.col(P + "description_normalized_fr").alias("normalized_fr"),
        "text_en",
        "text_fr",
        "text_seq",
        "text_para",
        _joined(P + "keywords_en").alias("keywords_en"),
    )


@_query(
    _with(Q.RECORDS_CTE, Q.texts_cte()) + f"select {fv.ID}, {_TEXT_OUT} from twice",
)
def prepare_text_keep_eo(spark: SparkSession, d: str) -> DataFrame:
    return prepare_text(records(spark, d), keep_eo=True).select(
        fv.ID, "text_en", "text_fr", "text_seq", "text_para"
    )


@_query(
    _with(
        Q.RECORDS_CTE,
        Q.texts_cte(),
        *_split_sql("prepared", f"{fv.ID}", fv.ID).rsplit("\nselect ", 1)[:1],
    )
    + "select "
    + _split_sql("prepared", f"{fv.ID}", fv.ID).rsplit("\nselect ", 1)[1]
)
def prepare_text_split(spark: SparkSession, d: str) -> DataFrame:
    # Counting reads the ids several times: from a table, not from the plan that finds them. The
    # result is read later still, so the table stays for the checkpoint folder's own clean-up.
    prepared, _ = stage(prepare_text(records(spark, d)).select(fv.ID), "prepared-ids")
    return assign_split(prepared, 0.1, 42, [fv.ID])


@_query(
    _with(*_ENRICH_CTES, Q.texts_cte())
    + f"""select p.{fv.ID}, nullif({P}date_published_date, {_NA}) as published,
 nullif({P}date_created_date, {_NA}) as created,
 {_SRC_SQL} as source,
 array_to_string({Q.items(P + 'topicCategory')}, '|') as topics,
 {_gone(P + 'temporalExtent_begin')} as extent_begin, {_gone(P + 'temporalExtent_end')} as extent_end,
 array_to_string({Q.option_descriptions(_OPT)}, '|') as kinds, {Q.mappable(_OPT)} as mappable,
 {Q.organisation(_CITED, _CONTACT, 'en')} as org_en, {Q.organisation(_CITED, _CONTACT, 'fr')} as org_fr,
 array_to_string(e.themes, '|') as themes,
 case when list_contains(e.themes, 'foundational') then 'true' else 'false' end as foundational,
 features_popularity, {_TEXT_OUT}
 from prepared p join enriched e on e.id = p.{fv.ID}""",
    "prepare_full",
)
def _prepare_full(spark: SparkSession, d: str) -> DataFrame:
    df = prepare_full(records(spark, d), theme_lookup(spark, d), foundational_lookup(spark, d))
    return df.select(
        fv.ID,
        F.col(P + "date_published_date").alias("published"),
        F.col(P + "date_created_date").alias("created"),
        F.col(_SRC).alias("source"),
        _joined(P + "topicCategory").alias("topics"),
        F.col("temporalExtent.begin").alias("extent_begin"),
        F.col("temporalExtent.end").alias("extent_end"),
        _joined(P + "type").alias("kinds"),
        F.col(P + "mappable").alias("mappable"),
        F.col(P + "org.en").alias("org_en"),
        F.col(P + "org.fr").alias("org_fr"),
        _joined(P + "geo_theme").alias("themes"),
        F.col(P + "foundational").alias("foundational"),
        "features_popularity",
        "text_en",
        "text_fr",
        "text_seq",
        "text_para",
    )


# --- search and metrics --------------------------------------------------------------------------
# Query vectors are the mean vectors of the labels: whole tables on both sides, and work that
# grows linearly with them.

def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")


def _label_queries(spark: SparkSession, d: str) -> DataFrame:
    return label_means(_vectors(spark, d)).withColumnRenamed("label", "query_id")


def _means_sql(vectors: str, keys: str) -> str:
    return f"""means as (select {keys}, list(x order by i) as v from (
    select {keys}, i, avg(x) as x from (
      select {keys}, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from {vectors})
    group by {keys}, i) group by {keys})"""


_MEANS_CTE = _means_sql("embeddings", "label")
_SCORES = {
    "cosine": "list_cosine_similarity({a}, {b})",
    "euclidean": "1 - list_distance({a}, {b})",
    "sqeuclidean": "1 - list_distance({a}, {b}) ** 2",
    "cityblock": "1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
    "chebyshev": "1 - list_max(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))",
    "canberra": "1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: case when p[1] = 0 and p[2] = 0"
    " then 0 else abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) end))",
    "braycurtis": "1 - list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
    " / list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] + p[2])))",
    "correlation": "list_cosine_similarity(list_transform({a}, lambda x: x - list_avg({a})),"
    " list_transform({b}, lambda x: x - list_avg({b})))",
}


def _hits_sql(metric: str, k: int) -> str:
    score = _SCORES[metric].format(a="m.v", b="e.embedding::double[]")
    return _with(
        _MEANS_CTE,
        f"scored as (select m.label as query_id, e.vec_id as doc_id, round({score}, 9) as s from means m, embeddings e)",
        f"""hits as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rank
  from scored qualify rank <= {k})""",
    )


def _register_top_k(metric: str, k: int, held: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = top_k(_label_queries(spark, d), _corpus(spark, d), k, metric, held)
        return hits.withColumn("score", F.round("score", 6))

    sql = _hits_sql(metric, k) + "select query_id, doc_id, round(s, 6) as score, rank::integer as rank from hits"
    _query(sql, f"topk_{metric}" + (f"_{held}_held" if held else ""))(run)


def _register_pruned(metric: str, k: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = pruned_top_k(_label_queries(spark, d), _corpus(spark, d), k, metric).hits
        return hits.withColumn("score", F.round("score", 6))

    sql = _hits_sql(metric, k) + "select query_id, doc_id, round(s, 6) as score, rank::integer as rank from hits"
    _query(sql, f"topk_{metric}_pruned")(run)


for _metric in _SCORES:
    _register_top_k(_metric, 5)
for _metric in ("cosine", "euclidean"):
    _register_pruned(_metric, 5)
_register_top_k("cosine", 5, "queries")  # one mean vector for each label


@_query(_hits_sql("cosine", 1) + "select query_id, doc_id, round(s, 6) as score from hits")
def best_answer(spark: SparkSession, d: str) -> DataFrame:
    queries = _label_queries(spark, d)
    hits = top_k(queries, _corpus(spark, d), 1).withColumn("score", F.round("score", 6))
    return metrics.best_answers(queries, hits)


# Evaluation queries: every vector looks for the mean vector of its label.

_NEAREST_CTES = f"""{_MEANS_CTE},
scored as (select e.vec_id as query_id, m.label as doc_id, e.label as wanted,
  round(list_cosine_similarity(m.v, e.embedding::double[]), 9) as s from means m, embeddings e),
hits as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rank
  from scored)"""


def _vector_queries(vecs: DataFrame) -> DataFrame:
    return vecs.select(F.col("vec_id").alias("query_id"), "embedding")


def _label_corpus(vecs: DataFrame) -> DataFrame:
    return label_means(vecs).withColumnRenamed("label", "doc_id")


def _vector_labels(vecs: DataFrame) -> DataFrame:
    return vecs.select(F.col("vec_id").alias("query_id"), F.col("label").alias("doc_id"))


@_query(
    f"""with {_NEAREST_CTES}
select round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as acc_at_k,
 round(avg(case when rank <= 5 then 1.0 / rank else 0.0 end), 6) as mrr_at_k, count(*) as labelled
from hits where doc_id = wanted"""
)
def acc_mrr_at_5(spark: SparkSession, d: str) -> DataFrame:
    vecs = _vectors(spark, d)
    hits = top_k(_vector_queries(vecs), _label_corpus(vecs), 5)
    return _rounded(metrics.evaluate(hits, _vector_labels(vecs), 5))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


@_query(
    f"""with {_NEAREST_CTES},
listed as (select vec_id as query_id, [(label + 3) % 10, label, (label + 5) % 10] as related from embeddings),
seen as (select l.query_id, h.rank, list_position(l.related, h.doc_id) as pos
  from listed l join hits h on h.query_id = l.query_id and h.rank <= 3
  and list_contains(l.related, h.doc_id)),
firsts as (select query_id, arg_min(rank, pos) as rank from seen group by query_id)
select round(sum(coalesce(1.0 / f.rank, 0)) / count(*), 6) as mrr, count(*) as queries
from listed l left join firsts f on f.query_id = l.query_id"""
)
def mrr_first_listed(spark: SparkSession, d: str) -> DataFrame:
    vecs = _vectors(spark, d)
    label = F.col("label")
    items = F.array((label + 3) % 10, label, (label + 5) % 10).cast("array<string>")
    written = F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))
    listed = vecs.select(
        F.col("vec_id").alias("query_id"),
        text_list(written).cast("array<int>").alias("related_documents"),
    )
    hits = top_k(_vector_queries(vecs), _label_corpus(vecs), 3)
    return _rounded(metrics.first_listed_mrr(hits, listed))


_SIGNED = "list_transform(embedding, lambda x: sign(x)::float)"


@_query(
    f"""with twin as (select 'full' as model, vec_id, label, embedding from embeddings
  union all select 'signs', vec_id, label, {_SIGNED} from embeddings),
{_means_sql('twin', 'model, label')},
scored as (select e.model, e.vec_id as query_id, m.label as doc_id, e.label as wanted,
  round(list_cosine_similarity(m.v, e.embedding::double[]), 9) as s
  from means m join twin e on e.model = m.model),
hits as (select *, row_number() over (partition by model, query_id order by s desc, doc_id) as rank
  from scored)
select model, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as acc_at_k,
 round(avg(case when rank <= 5 then 1.0 / rank else 0.0 end), 6) as mrr_at_k, count(*) as labelled
from hits where doc_id = wanted group by model"""
)
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    full = _vectors(spark, d)
    signs = full.withColumn(
        "embedding", F.transform("embedding", lambda x: F.signum(x).cast("float"))
    )
    hits, labels = [], []
    for model, vecs in (("full", full), ("signs", signs)):
        found = top_k(_vector_queries(vecs), _label_corpus(vecs), 5)
        hits.append(found.withColumn("model", F.lit(model)))
        labels.append(_vector_labels(vecs).withColumn("model", F.lit(model)))
    return _rounded(metrics.evaluate(union_by_name(hits), union_by_name(labels), 5, ["model"]))


# Keyword search: every benchmark item looks for the documents that hold one of its words.


def _keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_KEYWORD_CTES = f"""tokens as (select item_id as query_id, {_TOKENS} as tokens from benchmark),
matched as (select t.query_id, d.doc_id from tokens t, (select doc_id, lower(text) as low from documents) d
  where len(list_filter(t.tokens, lambda w: contains(d.low, w))) > 0),
hits as (select *, row_number() over (partition by query_id order by doc_id) as rank
  from matched qualify rank <= 5)"""


@_query(f"with {_KEYWORD_CTES} select query_id, doc_id, rank::integer as rank from hits")
def keyword_top5(spark: SparkSession, d: str) -> DataFrame:
    return keyword_first(_keyword_queries(spark, d), documents(spark, d), 5)


@_query(f"with {_KEYWORD_CTES} select query_id, doc_id, rank::integer as rank from hits")
def keyword_top5_indexed(spark: SparkSession, d: str) -> DataFrame:
    index = build_index(documents(spark, d).select("doc_id", "text"))
    return first_documents(index, _keyword_queries(spark, d), 5).hits


@_query(
    f"""with {_KEYWORD_CTES.replace('select doc_id, lower', 'select doc_id, row_number() over () as pos, lower').replace(
        't.query_id, d.doc_id from', 't.query_id, d.doc_id, d.pos from').replace('order by doc_id', 'order by pos')}
select query_id, doc_id, rank::integer as rank from hits"""
)
def keyword_top5_in_file_order(spark: SparkSession, d: str) -> DataFrame:
    corpus = with_file_position(table(spark, d, "documents").select("doc_id", "text"))
    return first_documents(build_index(corpus, ["position"]), _keyword_queries(spark, d), 5).hits


@_query(
    f"""with {_KEYWORD_CTES}
select round(avg(case when h.rank is not null then 1.0 else 0.0 end), 6) as acc_at_k
from tokens t left join hits h on h.query_id = t.query_id and h.doc_id = t.query_id"""
)
def keyword_accuracy(spark: SparkSession, d: str) -> DataFrame:
    queries = _keyword_queries(spark, d)
    hits = keyword_first(queries, documents(spark, d), 5)
    labels = queries.select("query_id", F.col("query_id").alias("doc_id"))
    ranks = metrics.label_ranks(hits, labels)
    return _rounded(ranks.agg(metrics.accuracy().alias("acc_at_k")))


# --- inference with stand-in models ---------------------------------------------------------------

LETTERS = "eanitros"


def letter_model():
    """Stand-in embedding model: unit vector of letter counts."""

    def model(batch):
        counts = np.array([[t.count(x) for x in LETTERS] for t in batch], dtype=float)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)

    return model


def question_model():
    """Stand-in question generator."""
    return lambda batch: [f" What is the {t}?" for t in batch]


_COUNTS = "[" + ", ".join(f"(length(text) - length(replace(text, '{x}', '')))::double" for x in LETTERS) + "]"
_LETTER_CTE = f"""counts as (select doc_id, {_COUNTS} as c from documents),
letters as (select doc_id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) as v
  from counts)"""
_DIMS = ", ".join(f"round(v[{i + 1}], 6) as {x}" for i, x in enumerate(LETTERS))


@_query(f"with {_LETTER_CTE} select doc_id, {_DIMS} from letters", "embed_texts")
def _embed_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    v = embed_texts(docs, "text", letter_model)
    return v.select(
        "doc_id", *[F.round(F.get("embedding", F.lit(i)), 6).alias(x) for i, x in enumerate(LETTERS)]
    )


@_query(f"select doc_id, {Q.strip('text || chr(63)')} as question from documents", "generate_questions")
def _generate_questions(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return generate_questions(docs, "text", "question", question_model).select("doc_id", "question")


_QUERY_COUNTS = _COUNTS
_J3_CTES = f"""{_LETTER_CTE},
{_KEYWORD_CTES.replace('hits as', 'keyword_hits as')},
asked as (select item_id as query_id, {_QUERY_COUNTS} as c from benchmark),
scored as (select a.query_id, l.doc_id,
  round(nullif(list_cosine_similarity(a.c, l.v), 'nan'::double), 9) as s from asked a, letters l),
hits as (select *, row_number() over (partition by query_id order by s desc nulls last, doc_id) as rank
  from scored qualify rank <= 5)"""


def _evaluation(spark: SparkSession, d: str):
    items = table(spark, d, "benchmark")
    queries = items.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.col("text").alias("query_fr"),
        F.col("item_id").alias("doc_id"),
    )
    corpus = documents(spark, d).select("doc_id", "text")
    return evaluate_search(queries, corpus, letter_model)


@_query(
    f"""with {_J3_CTES}
select round(avg(case when h.rank is not null then 1.0 else 0.0 end), 6) as acc_at_k,
 round(avg(coalesce(1.0 / h.rank, 0)), 6) as mrr_at_k,
 round(avg(case when k.rank is not null then 1.0 else 0.0 end), 6) as keyword_acc_at_k,
 count(*) as labelled
from tokens t left join hits h on h.query_id = t.query_id and h.doc_id = t.query_id
left join keyword_hits k on k.query_id = t.query_id and k.doc_id = t.query_id""",
    "evaluate_search",
)
def _evaluate_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_evaluation(spark, d).metrics)


@_query(
    f"""with {_LETTER_CTE},
asked as (select query_id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) as v
  from (select item_id as query_id, {_COUNTS} as c from benchmark)),
scored as (select a.query_id, l.doc_id, round(1 - list_distance(a.v, l.v), 9) as s from asked a, letters l),
hits as (select *, row_number() over (partition by query_id order by s desc, doc_id) as rank
  from scored qualify rank <= 5)
select query_id, doc_id, round(s, 6) as score, rank::integer as rank from hits"""
)
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search(queries, documents(spark, d).select("doc_id", "text"), letter_model, 5, "euclidean")
    return hits.withColumn("score", F.round("score", 6))


@_query(
    f"""with {_J3_CTES}
select query_id, query_id as doc_id, string_agg(doc_id::varchar, '|' order by rank) as top_ids
from hits group by query_id""",
)
def search_predictions(spark: SparkSession, d: str) -> DataFrame:
    found = _evaluation(spark, d).predictions
    return found.select("query_id", "doc_id", _joined("top_ids").alias("top_ids"))


VOWELS = "aeio"


def vowel_model():
    """Another stand-in: vowels only."""

    def model(batch):
        counts = np.array([[t.count(x) for x in VOWELS] for t in batch], dtype=float)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)

    return model


def _listed_sql(name: str, letters: str, part: str, first: int) -> str:
    counts = "[" + ", ".join(f"(length(text) - length(replace(text, '{x}', '')))::double" for x in letters) + "]"
    return f"""{name}_scored as (
  select q.query_id, d.doc_id, q.related, round(nullif(list_cosine_similarity(q.c, d.c), 'nan'::double), 9) as s
  from (select item_id as query_id, {counts} as c, list_transform(range(100), lambda i: (3 * i + item_id % {first})::bigint) as related
    from benchmark where {part}) q, (select doc_id, {counts} as c from documents) d),
{name}_hits as (select *, row_number() over (partition by query_id order by s desc nulls last, doc_id) as rank
  from {name}_scored qualify rank <= 5),
{name} as (select query_id, arg_min(rank, list_position(related, doc_id)) filter (where list_contains(related, doc_id)) as rank
  from {name}_hits group by query_id)"""


@_query(
    f"""with {_listed_sql('letters', LETTERS, 'true', 7)}, {_listed_sql('vowels', VOWELS, 'item_id % 2 = 0', 5)}
select 'letters' as model, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr, count(*) as queries from letters
union all select 'vowels', round(avg(coalesce(1.0 / rank, 0)), 6), count(*) from vowels"""
)
def compare_listed_models(spark: SparkSession, d: str) -> DataFrame:
    """Each model on a list of queries of its own."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")

    def asked(queries: DataFrame, first: int) -> DataFrame:
        related = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: 3 * i + F.col("query_id") % first)
        return queries.withColumn("related_documents", related)

    corpus = documents(spark, d).select("doc_id", "text")
    models = {
        "letters": (asked(items, 7), letter_model),
        "vowels": (asked(items.where("query_id % 2 = 0"), 5), vowel_model),
    }
    return _rounded(compare_listed(models, corpus))


# Token vectors: each embedding cut into token vectors of eight, some of them masked out.

_TOKEN_DIMS = [
    f"list_sum(list_transform(range(len(embedding) // 8), lambda t: embedding[t * 8 + {i + 1}]::double"
    " * (case when t <= label then 1 else 0 end))) / least(label + 1, len(embedding) // 8)"
    for i in range(8)
]


@_query(
    f"""with pooled as (select vec_id, [{", ".join(_TOKEN_DIMS)}] as p from embeddings)
select vec_id, {", ".join(f"round(p[{i + 1}] / greatest(sqrt(list_dot_product(p, p)), 1e-12), 6) as d{i}" for i in range(8))}
from pooled"""
)
def mean_pool_l2(spark: SparkSession, d: str) -> DataFrame:
    v = vectors.as_double(F.col("embedding"))
    places = F.sequence(F.lit(0), F.floor(F.size("embedding") / 8).cast("int") - 1)
    tokens = F.transform(places, lambda t: F.slice(v, 8 * t + 1, F.lit(8)))
    mask = F.transform(places, lambda t: (t <= F.col("label")).cast("int"))
    pooled = _vectors(spark, d).select("vec_id", vectors.mean_pool(tokens, mask).alias("p"))
    unit = pooled.select("vec_id", vectors.l2_normalize(F.col("p")).alias("u"))
    return unit.select(
        "vec_id", *[F.round(F.get("u", F.lit(i)), 6).alias(f"d{i}") for i in range(8)]
    )


# --- training pairs ---------------------------------------------------------------------------------

_SENTENCES_CTE = f"cut as (select doc_id as record_id, {Q.sentences('text')} as s from documents)"


@_query(
    f"""with {_SENTENCES_CTE},
numbered as (select record_id, s, unnest(range(len(s) - 1)) as pos from cut where len(s) > 1)
select record_id, pos::integer as pos, s[pos + 1] as text_a, s[pos + 2] as text_b from numbered""",
    "adjacent_pairs",
)
def _adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return adjacent_pairs(documents(spark, d), "doc_id", "text")


@_query(
    f"""with {_SENTENCES_CTE}
select record_id, coalesce(array_to_string(s[1:len(s) // 2], ' '), '') as text_a,
 coalesce(array_to_string(s[len(s) // 2 + 1:], ' '), '') as text_b from cut""",
    "text_halves",
)
def _text_halves(spark: SparkSession, d: str) -> DataFrame:
    return text_halves(documents(spark, d), "doc_id", "text")


@_query(f"with {_SENTENCES_CTE} select record_id, len(s)::integer as sentences, array_to_string(s, '|') as cut from cut")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    cut = sentences.split_sentences(F.col("text"))
    rows = documents(spark, d).select(F.col("doc_id").alias("record_id"), cut.alias("s"))
    return rows.select("record_id", F.size("s").alias("sentences"), _joined("s").alias("cut"))


_TERMS = {
    "core": r"regexp_replace(regexp_replace({0}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', '')",
    "kind": r"lower(regexp_replace({0}, '\.$', ''))",
}


def _core_sql(x: str) -> str:
    return _TERMS["core"].format(x)


def _kind_sql(x: str) -> str:
    return _TERMS["kind"].format(x)


_LIKELIHOOD = "({0}) * ln(greatest(least({2}, 1 - 1e-12), 1e-12)) + ({1} - ({0})) * ln(1 - greatest(least({2}, 1 - 1e-12), 1e-12))"
_BOUND_SQL = f"(regexp_matches({_kind_sql('core')}, '^\\p{{L}}$') or {_kind_sql('core')} in (select word from abbreviations))"


@_query(
    rf"""with docs as (select doc_id, text from documents),
cut as materialized (
  select doc_id, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '') as tokens from docs),
placed as (select doc_id, tokens, unnest(range(1, len(tokens) + 1)) as i from cut),
tokens as materialized (
  select tokens[i] as token, {_core_sql('tokens[i]')} as core, {_core_sql('tokens[i + 1]')} as next from placed),
counts as materialized (
  select {_kind_sql('core')} as word, count(*) filter (where ends_with(core, '.')) as dotted,
    count(*) filter (where not ends_with(core, '.')) as plain
  from tokens group by 1 having regexp_matches({_kind_sql('any_value(core)')}, '\p{{L}}')),
totals as (select sum(dotted)::double as dots, sum(dotted + plain)::double as whole from counts),
sized as (
  select counts.*, dots / whole as p, length(word) - length(replace(word, '.', '')) as inside, length(replace(word, '.', '')) as size
  from counts, totals where dotted > 0),
abbreviations as materialized (
  select word from sized
  where 2 * (dotted * ln(0.99) + plain * ln(0.01) - dotted * ln(p) - plain * ln(1 - p))
    * exp(-size) * (inside + 1) * power(size::double, -plain) >= 0.3),
begun as materialized (
  select next from tokens where next is not null
    and ((ends_with(core, '.') and not {_BOUND_SQL}) or regexp_matches(token, '[!?][^\p{{L}}\p{{N}}]*$'))),
started as (
  select {_kind_sql('next')} as word, count(*)::double as ab, (select count(*)::double from begun) as a,
    (select whole from totals) as n from begun where regexp_matches(next, '^\p{{Lu}}') group by 1),
rated as (
  select s.*, (c.dotted + c.plain)::double as b, greatest(n - a, 1.0) as rest, greatest(c.dotted + c.plain - ab, 0.0) as others
  from started s join counts c using (word)),
starters as materialized (
  select word from rated where ab / a > b / n and 2 * (
    {_LIKELIHOOD.format('ab', 'a', 'ab / a')} + {_LIKELIHOOD.format('others', 'rest', 'others / rest')}
    - ({_LIKELIHOOD.format('ab', 'a', 'b / n')}) - ({_LIKELIHOOD.format('others', 'rest', 'b / n')})) > 30),
pieces as (
  select doc_id, string_split(regexp_replace(text, '([.!?])([ \t\n\x0B\f\r])', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from docs),
numbered as (select doc_id, p, unnest(range(1, len(p) + 1)) as i from pieces),
neighbours as (
  select doc_id, i, p[i] as piece, regexp_extract(p[i - 1], '([^ \t\n\x0B\f\r]+)$', 1) as last,
    {_core_sql("regexp_extract(p[i], '^[ \t\n\x0B\f\r]+([^ \t\n\x0B\f\r]+)', 1)")} as first from numbered),
judged as (
  select *, {_core_sql('last')} as core from neighbours),
flagged as (
  select *, i > 1 and (not (ends_with(last, '.') and {_BOUND_SQL})
    or ({_kind_sql('first')} in (select word from starters) and regexp_matches(first, '^\p{{Lu}}'))) as new from judged),
grouped as (
  select *, sum(new::int) over (partition by doc_id order by i) as g from flagged),
sentences as (
  select doc_id, g, string_agg(case when new then ltrim(piece, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) else piece end, '' order by i) as s
  from grouped group by doc_id, g)
select d.doc_id as record_id, count(s)::integer as sentences, coalesce(string_agg(s, '|' order by g), '') as cut
from docs d left join sentences x on x.doc_id = d.doc_id and s <> '' group by d.doc_id"""
)
def split_sentences_learned(spark: SparkSession, d: str) -> DataFrame:
    texts = documents(spark, d).select("doc_id", "text")
    splitter = learn_splitter(texts, "text")
    rows = texts.select(F.col("doc_id").alias("record_id"), splitter(F.col("text")).alias("s"))
    return rows.select("record_id", F.size("s").alias("sentences"), _joined("s").alias("cut"))

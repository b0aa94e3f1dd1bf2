"""Record tables derived from the given tables.

The expressions mean the same in Spark SQL and in the checking engine. Every document becomes one
record and its whole text goes into both descriptions; the cases add what the plain texts lack:
links, drawn tables, section headers, symbols, JSON columns, placeholders, nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep_spark import fixed_values as fv

_NL, _BS = "chr(10)", "chr(92)"

_TABLE = (
    f"text || {_NL} || '+---+---+' || {_NL} || '| A' || {_BS} || ' | B' || {_BS} || ' |' || {_NL}"
    f" || '| ' || {_BS} || ' | ' || {_BS} || ' |' || {_NL} || '+---+---+---+' || {_NL} || 'after'"
)
_SPACED = (
    f"'  lead   ' || text || '   spaced' || {_NL} || {_NL} || {_NL} || '  out' || {_NL} || '  '"
    f" || {_NL} || 'x  '"
)

EXPRESSIONS = {
    "id": "'rec-' || doc_id",
    "title_en": "source || ' ' || lang",
    "title_fr": "case when doc_id % 11 = 0 then null else 'FR ' || source end",
    "description_en": f"""case doc_id % 8
      when 0 then 'See https://www.site.example.com:8080/p?q=1 now. ' || text
      when 1 then text || ' mail a.b+c@ex.example.org!!!'
      when 2 then {_TABLE}
      when 3 then text || ' References: dropped tail'
      when 4 then text || ' 5° --> 6°' || {_BS} || 'nnext'
      when 5 then {_SPACED}
      when 6 then null
      else text end""",
    "description_fr": """case doc_id % 5
      when 0 then 'FR ' || text || ' Références: fin'
      when 1 then 'FR ' || text || ' 3° -> 4° ftp.ex.example.ca/x'
      when 2 then null
      else 'FR ' || text end""",
    "keywords_en": "source || ' , ' || lang || ',records ,'",
    "keywords_fr": "case when doc_id % 7 = 0 then null else 'a, b ,c' end",
    "topicCategory": """case doc_id % 5
      when 0 then 'boundaries, Economy' when 1 then ' oceans,biota,unknown' when 2 then null
      when 3 then 'health' else 'transport,structure,location' end""",
    "options": """case doc_id % 7
      when 0 then '[{"protocol":"OGC:WMS","description":{"en":"Map service; WMS","fr":"S; W"}},"""
    """{"protocol":"HTTPS","description":{"en":"Data","fr":"D"}}]'
      when 1 then '{"protocol":"ESRI REST: Map","description":{"en":" Single ; x"}}'
      when 2 then '[{"protocol":null,"description":{"en":"a"}},{"protocol":"ogc","description":null}]'
      when 3 then 'invalid json'
      when 4 then null
      when 5 then '[{"protocol":"OGC","description":{"en":"cut"}}] trailing'
      else '[{"name":"n","description":{"en":"b;1"}},7,{"description":{"en":"b ;2"}}]' end""",
    "cited": """case doc_id % 4
      when 0 then '[{"organisation":{"en":"Gov; Cited Org; x","fr":"Gouv; Org cite"}}]'
      when 1 then '[{"organisation":{"en":null,"fr":null}}]'
      when 2 then '[]' else null end""",
    "contact": """case doc_id % 3
      when 0 then '[{},{"organisation":{"en":"Gov; Contact Org","fr":"Gouv"}}]'
      when 1 then '[null]' else '{"organisation":{"en":"Gov; Not A List"}}' end""",
    "date_published_date": """case doc_id % 3
      when 0 then 'Not Available; Indisponible' when 1 then '2020-01-01' else null end""",
    "date_created_date": """case doc_id % 4
      when 0 then 'Not Available; Indisponible' else '2019-05-01' end""",
    "temporalExtent_begin": """case doc_id % 5
      when 0 then 'Not Available; Indisponible' else '2001-01-01' end""",
    "temporalExtent_end": """case doc_id % 3
      when 0 then 'Present' when 1 then '2011-01-01' else null end""",
    "sourceSystemName": f"""case doc_id % 3
      when 0 then '{fv.LEGACY_SOURCE}' when 1 then null else source end""",
    "eoCollection": "case when doc_id % 9 = 0 then 'sentinel' else null end",
    "spatialRepresentation": "'vector'",
    "type": "'dataset'",
    "graphicOverview": "cast(null as varchar(10))",
    "language": "lang",
    "eoFilters": "cast(null as varchar(10))",
}
BARE_EXPRESSIONS = {
    "features_geometry_coordinates": "cast(null as varchar(10))",
    "features_popularity": "doc_id % 100",
}


def _select_list() -> list[str]:
    named = {fv.P + name: text for name, text in EXPRESSIONS.items()} | BARE_EXPRESSIONS
    return [f"{text} as {name}" for name, text in named.items()]


RECORDS_SQL = "select " + ",\n ".join(_select_list()) + " from documents"

# repeated tags, tags that are not allowed, empty and null tags
THEME_LOOKUP_SQL = """
select 'rec-' || doc_id as uuid, case when toxic = 1 then 'legal' else 'other' end as tag from labels
union all select 'rec-' || doc_id, case when quality = 1 then 'emergency' else '' end from labels
union all select 'rec-' || doc_id, case when quality = 1 then 'emergency' else null end from labels
"""
FOUNDATIONAL_LOOKUP_SQL = """
select 'rec-' || doc_id as uuid,
 case when doc_id % 10 = 0 then 'foundational' else 'tag' || (doc_id % 3) end as tag from labels
"""


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").select("doc_id", "text", "lang", "source")


def records(spark: SparkSession, directory: str, partitions: int | None = None) -> DataFrame:
    """The record table; dealt over so many partitions, if given, else as its files are read."""
    rows = documents(spark, directory)
    return (rows.repartition(partitions) if partitions else rows).selectExpr(*_select_list())


def theme_lookup(spark: SparkSession, directory: str) -> DataFrame:
    labels = table(spark, directory, "labels")
    return spark.sql(THEME_LOOKUP_SQL.replace("from labels", "from {labels}"), labels=labels)


def foundational_lookup(spark: SparkSession, directory: str) -> DataFrame:
    labels = table(spark, directory, "labels")
    return spark.sql(FOUNDATIONAL_LOOKUP_SQL.replace("from labels", "from {labels}"), labels=labels)


def label_means(vectors: DataFrame) -> DataFrame:
    """``(label, embedding)``: mean vector per label, whatever its length; summed before the shuffle."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    whole = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return whole.select("label", F.col("v.x").alias("embedding"))

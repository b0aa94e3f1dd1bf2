"""Reading record tables, labels, embeddings and lookup tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from textprep_spark import fixed_values as fv
from textprep_spark.functions.text import split_list


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_records(
    spark: SparkSession,
    directory: str,
    schema: T.StructType | None = None,
    pattern: str = "*.parquet",
) -> DataFrame:
    """All entries directly in ``directory`` that match ``pattern`` as one frame, matched by column
    name.

    Without a ``schema`` the files' schemas are merged, which reads every footer; give one to
    skip that. Raises ``ValueError`` when there is no such entry.
    """
    reader = spark.read
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    try:
        return reader.parquet(f"{directory.rstrip('/')}/{pattern}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"No parquet files found in {directory}") from e
        raise


def _as_declared(c: Column, have: T.DataType, want: T.DataType, name: str) -> Column:
    """A column of one type as another: text and lists of text turn into each other, the rest is cast."""
    if have == want:
        return c
    if isinstance(want, T.ArrayType) and isinstance(have, T.StringType):
        return split_list(c).cast(want)
    if isinstance(want, T.StringType) and isinstance(have, T.ArrayType):
        return F.array_join(c, ", ")
    nested = any(isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) for kind in (have, want))
    if nested and not (isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType)):
        raise ValueError(f"column {name}: {have.simpleString()} cannot become {want.simpleString()}")
    return c.cast(want)


def file_schemas(spark: SparkSession, directory: str, pattern: str = "*.parquet") -> list[tuple[T.StructType, list[str]]]:
    """The different schemas of the files in a folder, each with its files.

    Footers are read by tasks, a few files each, never by the driver, which learns one short
    fingerprint a file and one schema a group.
    """
    try:
        files = spark.read.format("binaryFile").load(f"{directory.rstrip('/')}/{pattern}").select("path")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise ValueError(f"No parquet files found in {directory}") from e
        raise

    def fingerprints(batches):
        import pyarrow.fs
        import pyarrow.parquet

        for batch in batches:
            told = []
            for path in batch["path"].to_pylist():
                source, place = pyarrow.fs.FileSystem.from_uri(path)
                told.append(from_arrow_schema(pyarrow.parquet.read_schema(place, filesystem=source)).json())
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(told, pa.string())], names=["path", "schema"])

    found = files.mapInArrow(fingerprints, "path string, schema string")
    found = found.select("path", F.sha2("schema", 256).alias("mark"), "schema").persist()
    try:
        schemas = {r["mark"]: r["schema"] for r in found.groupBy("mark").agg(F.min("schema").alias("schema")).collect()}
        groups: dict[str, list[str]] = {mark: [] for mark in sorted(schemas)}
        for row in found.select("path", "mark").orderBy("path").toLocalIterator():
            groups[row["mark"]].append(row["path"])
    finally:
        found.unpersist()
    return [(T.StructType.fromJson(json.loads(schemas[mark])), paths) for mark, paths in groups.items()]


def read_mixed_records(
    spark: SparkSession, directory: str, schema: T.StructType, pattern: str = "*.parquet", required: bool = False
) -> DataFrame:
    """The files of a folder as one frame of the given ``schema``, whatever types they hold.

    Files with equal schemas are read together; each group's columns are turned into the declared
    types (text into lists at its commas and back, numbers by casts) and matched by name. A column a
    file lacks is null there; with ``required``, one that every file lacks is an error. Columns that
    are not declared are not read.
    """
    frames, groups = [], file_schemas(spark, directory, pattern)
    absent = sorted(set(schema.names).difference(*[own.names for own, _ in groups]))
    if required and absent:
        raise ValueError(f"columns {absent} are in no file of {directory}")
    for own, paths in groups:
        names = {f.name: f.dataType for f in own.fields}
        read = T.StructType([f for f in own.fields if f.name in schema.names])
        group = spark.read.schema(read).parquet(*paths)
        columns = [
            _as_declared(F.col(f"`{f.name}`"), names[f.name], f.dataType, f.name) if f.name in names else F.lit(None).cast(f.dataType)
            for f in schema.fields
        ]
        frames.append(group.select(*[c.alias(f.name) for c, f in zip(columns, schema.fields)]))
    return union_by_name(frames)


def with_file_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Adds where each row stands in its files: a struct of path and row number, which orders rows as
    a reader of one file after another meets them and stays with them through every shuffle.

    For frames read from files, before any other step.
    """
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    return df.select("*", place.alias(name))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One parquet table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _csv(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> DataFrame:
    df = (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return df.select(*[F.when(~F.col(f"`{c}`").isin(fv.CSV_MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_label_queries(
    spark: SparkSession, path: str, encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Labelled queries: ``query``, ``query-fr``, ``doc_id`` and whatever else the CSV holds."""
    return _csv(spark, path, encoding, multi_line=True)


def _parsed(c: Column, kind: str, what: str, options: dict[str, str] | None = None) -> Column:
    """JSON text as ``kind``. Null stays null; any other text is an error, not a lost row."""
    value = F.from_json(c, kind, options or {})
    begin = F.substring(c, 1, 60)
    failed = F.raise_error(F.concat(F.lit(f"not {what}: "), begin)).cast(kind)
    return F.when(c.isNotNull(), F.coalesce(value, failed))


def text_list(c: Column) -> Column:
    """A list of strings written as JSON or with single quotes; other text raises."""
    return _parsed(c, "array<string>", "a list", {"allowSingleQuotes": "true"})


def read_listed_queries(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Queries with ``related_documents`` as an array. The list text is parsed, never run."""
    df = _csv(spark, path, encoding, multi_line=True)
    return df.withColumn("related_documents", text_list(F.col("related_documents")))


def embedding_source(
    df: DataFrame, doc_id: str = "doc_id", embedding: str = "embedding"
) -> DataFrame:
    """Any frame with ids and vectors as ``(doc_id, embedding)``; vectors may be JSON text."""
    vector = F.col(embedding)
    if isinstance(df.schema[embedding].dataType, T.StringType):
        vector = _parsed(vector, "array<double>", "a vector")
    return df.select(F.col(doc_id).alias("doc_id"), vector.alias("embedding"))


def read_embeddings_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, embedding)`` from a CSV whose vectors are JSON text."""
    return embedding_source(_csv(spark, path, "UTF-8", multi_line=False))


def lookup_table(items: DataFrame, tag_key: str = "tag") -> DataFrame:
    """``(uuid, tag)`` from an exported key-value table.

    Values may be plain strings or wrapped with their type (``{"S": "text"}``).
    """

    def value(name: str) -> Column:
        wrapped = isinstance(items.schema[name].dataType, T.StructType)
        return F.col(f"{name}.S") if wrapped else F.col(name)

    return items.select(value("uuid").alias("uuid"), value(tag_key).alias("tag"))


def read_lookup(spark: SparkSession, path: str, tag_key: str = "tag") -> DataFrame:
    """``(uuid, tag)`` from a JSON-lines export with typed values."""
    typed = T.StructType([T.StructField("S", T.StringType())])
    schema = T.StructType([T.StructField("uuid", typed), T.StructField(tag_key, typed)])
    return lookup_table(spark.read.schema(schema).json(path), tag_key)

"""Writing data sets and predictions, and staging intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_datasets(frames: Sequence[DataFrame], names: Sequence[str], directory: str) -> None:
    """Write each frame as the parquet table ``directory/name``.

    Frames and names are counted first: on a mismatch nothing is written.
    """
    if len(frames) != len(names):
        raise ValueError(f"{len(frames)} frames but {len(names)} names; nothing written")
    for frame, name in zip(frames, names):
        frame.write.mode("overwrite").parquet(f"{directory.rstrip('/')}/{name}")


def _file_system(spark: SparkSession, path: str):
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(context._jsc.hadoopConfiguration())


def write_sets(assigned: DataFrame, names: Mapping[str, str], directory: str, column: str = "split") -> None:
    """Write the rows of every value of ``column`` as the parquet table ``directory/name``, in one pass.

    ``names`` maps values to names; rows of other values are an error that leaves nothing behind. All
    sets are written beside their places first and renamed when complete, so no half-written set is
    ever seen, and a failed run leaves earlier sets as they were. Values without rows give empty tables.
    """
    spark, base = assigned.sparkSession, directory.rstrip("/")
    incoming = f"{base}/_incoming-{uuid.uuid4().hex}"
    root, files = _file_system(spark, incoming)
    known = F.coalesce(F.col(column).cast("string").isin(list(names)), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("no set for "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))
    checked = assigned.withColumn(column, F.when(known, F.col(column).cast("string")).otherwise(failed.cast("string")))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        checked.write.partitionBy(column).parquet(incoming)
        none = spark.createDataFrame([], assigned.drop(column).schema)
        for value in names:
            if not files.exists(path(f"{incoming}/{column}={value}")):
                none.write.parquet(f"{incoming}/{column}={value}")
        for value, name in names.items():
            target, before = path(f"{base}/{name}"), path(f"{incoming}/_before-{value}")
            if files.exists(target) and not files.rename(target, before):
                raise OSError(f"cannot replace {base}/{name}")
            if not files.rename(path(f"{incoming}/{column}={value}"), target):
                if files.exists(before):
                    files.rename(before, target)
                raise OSError(f"cannot rename to {base}/{name}")
    finally:
        files.delete(root, True)


def write_predictions(predictions: DataFrame, directory: str, model: str) -> str:
    """Write ``(doc_id, top_ids)`` as CSV under a name that holds the model's; returns the path."""
    path = f"{directory.rstrip('/')}/predicted_{model.rstrip('/').split('/')[-1]}"
    rows = predictions.select("doc_id", F.to_json("top_ids").alias("top_ids"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def output_directory(base: str, keep_eo: bool) -> str:
    """Where a preparation run writes: runs that keep earth-observation records stay apart."""
    base = base.rstrip("/")
    return f"{base}/with_eocollections" if keep_eo else base


def _shared_directory(spark: SparkSession) -> str:
    """Where intermediate tables go: ``spark.checkpoint.dir``, or, in local mode, the warehouse if that
    is unset. On a cluster the default warehouse is a folder of one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written once as a table in the shared folder and read back, and the table's path.

    Cuts the lineage: later steps read a fixed table, whichever executors are lost.
    """
    spark = df.sparkSession
    path = f"{_shared_directory(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The same for use in ``with``; the table is removed at the end."""
    table, path = stage(df, name)
    try:
        yield table
    finally:
        location, files = _file_system(df.sparkSession, path)
        files.delete(location, True)

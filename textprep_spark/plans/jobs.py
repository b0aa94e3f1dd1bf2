"""Batch jobs for ``spark-submit``.

    spark-submit --py-files textprep_spark.zip textprep_spark/plans/jobs.py \
        --input-dir <dir> --output-dir <dir> [--holdout 0.1] [--seed 42] [--keep-eo] [--mixed]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep_spark import fixed_values as fv
from textprep_spark.functions.documents import record_text
from textprep_spark.operators.cleaning import require_columns
from textprep_spark.operators.split import KEY, assign_by_key, split_key
from textprep_spark.plans.prepare import distinct_records, document_texts
from textprep_spark.sources.readers import read_mixed_records, read_records
from textprep_spark.sources.writers import output_directory, staged, write_sets

SET_NAMES = {name: f"{name}.parquet" for name in ("train", "eval", "test")}


@dataclass(frozen=True)
class PrepareTextConfig:
    input_dir: str
    output_dir: str
    holdout: float = 0.1
    seed: int = 42
    keep_eo: bool = False
    mixed: bool = False  # the files' types differ


KEYWORD_LISTS = T.StructType(
    [
        T.StructField(c, T.ArrayType(T.StringType()) if c.startswith(fv.P + "keywords") else T.StringType())
        for c in fv.TEXT_COLUMNS
    ]
)


def run_prepare_text(spark: SparkSession, config: PrepareTextConfig) -> str:
    """Read records, prepare their texts, write train, eval and test sets; returns the directory.

    The distinct records are staged as a table once, each with its split key. Counting for the
    split then reads the key column alone, and the three sets are written in one pass, so nothing is
    normalised, compared or read again for each of them. The four document texts, which repeat what the record holds several times over,
    are only put together as they are written. Duplicate removal has made the English text
    unique, so with the id it makes a key that no two records share.
    """
    if config.mixed:
        records = read_mixed_records(spark, config.input_dir, KEYWORD_LISTS, required=True)
    else:
        records = read_records(spark, config.input_dir)
    distinct = distinct_records(require_columns(records, fv.TEXT_COLUMNS), keep_eo=config.keep_eo)
    key = split_key(config.seed, [F.col(fv.ID), F.md5(record_text(distinct, ["en"]))])
    target = output_directory(config.output_dir, config.keep_eo)
    with staged(distinct.withColumn(KEY, key), "distinct-records") as table:
        assigned = document_texts(assign_by_key(table, F.col(KEY), config.holdout).drop(KEY))
        write_sets(assigned, SET_NAMES, target)
    return target


def parse_args(argv: Sequence[str] | None = None) -> PrepareTextConfig:
    parser = argparse.ArgumentParser(description="Prepare record texts for training.")
    parser.add_argument("--input-dir", required=True, help="folder of record parquet files")
    parser.add_argument("--output-dir", required=True, help="folder the three sets go to")
    parser.add_argument("--holdout", type=float, default=0.1, help="share held out, split in two")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--keep-eo", action="store_true", help="keep earth-observation records")
    parser.add_argument("--mixed", action="store_true", help="the files' column types differ")
    return PrepareTextConfig(**vars(parser.parse_args(argv)))


def main(argv: Sequence[str] | None = None) -> None:
    config = parse_args(argv)
    spark = SparkSession.builder.appName("prepare-text").getOrCreate()
    run_prepare_text(spark, config)


if __name__ == "__main__":
    main()

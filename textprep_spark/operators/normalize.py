"""Text normalisation over whole frames, and counting what it changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textprep_spark.functions.text import DEFAULT_LANGUAGES, LanguageConfig, chain, normalize


def language_columns(
    columns: Sequence[str], languages: Mapping[str, LanguageConfig]
) -> list[tuple[str, str, str]]:
    """``(source, target, language)`` for each column; a name without a known language suffix
    stands for its variants in every language."""
    out = []
    for name in columns:
        base, sep, suffix = name.rpartition("_")
        pairs = [(base, suffix)] if sep and suffix in languages else [(name, x) for x in languages]
        out += [(f"{b}_{lang}", f"{b}_normalized_{lang}", lang) for b, lang in pairs]
    return out


def normalize_columns(
    df: DataFrame,
    columns: Sequence[str],
    languages: Mapping[str, LanguageConfig] | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Add ``<base>_normalized_<lang>`` next to each text column; the originals stay.

    With an ``observation``, the number of rows each step changed (and of null rows) is counted
    while the data flows by, under ``<target>.<step>``; no extra pass is made.
    """
    languages = DEFAULT_LANGUAGES if languages is None else languages
    targets = language_columns(columns, languages)
    if observation is None:
        return df.withColumns(
            {target: normalize(F.col(source), languages[lang]) for source, target, lang in targets}
        )
    counts: list[Column] = []
    flags: list[str] = []
    for source, target, lang in targets:
        df = df.withColumn(target, F.col(source))
        for i, step in enumerate(chain(languages[lang])):
            before, flag = f"__before_{target}", f"__changed_{target}_{i}"
            df = df.withColumn(before, F.col(target)).withColumn(target, step.apply(F.col(target)))
            df = df.withColumn(flag, ~F.col(before).eqNullSafe(F.col(target))).drop(before)
            flags.append(flag)
            counts.append(F.count_if(F.col(flag)).alias(f"{target}.{step.name}"))
        counts.append(F.count_if(F.col(source).isNull()).alias(f"{target}.nulls"))
    return df.observe(observation, *counts).drop(*flags)


def apply_and_count(
    df: DataFrame,
    column: str,
    fn: Callable[..., Column],
    observation: Observation | None = None,
    **options: object,
) -> DataFrame:
    """Rewrite ``column`` with ``fn(column, **options)``.

    ``fn`` maps a Column to a Column: a built-in expression or a pandas UDF. The observation
    receives ``changed_rows`` and ``null_rows``.
    """
    before, after = F.col("__before"), F.col(column)
    df = df.withColumn("__before", after).withColumn(column, fn(after, **options))
    if observation is not None:
        df = df.observe(
            observation,
            F.count_if(~before.eqNullSafe(after)).alias("changed_rows"),
            F.count_if(before.isNull()).alias("null_rows"),
        )
    return df.drop("__before")


def change_report(df: DataFrame, column: str, config: LanguageConfig) -> DataFrame:
    """One row per step of the chain: ``(step_no, step, changed_rows, null_rows)``.

    All steps are counted in one pass over the column and one small aggregate.
    """
    steps = chain(config)
    work = df.select(F.col(column).alias("__v0"))
    for i, step in enumerate(steps):
        work = work.withColumn(f"__v{i + 1}", step.apply(F.col(f"__v{i}")))
        same = F.col(f"__v{i}").eqNullSafe(F.col(f"__v{i + 1}"))
        work = work.withColumn(f"__c{i}", ~same).drop(*([f"__v{i}"] if i else []))
    totals = work.agg(
        F.count_if(F.col("__v0").isNull()).alias("null_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(i + 1).alias("step_no"),
                    F.lit(step.name).alias("step"),
                    F.count_if(F.col(f"__c{i}")).alias("changed_rows"),
                )
                for i, step in enumerate(steps)
            ]
        ).alias("steps"),
    )
    return totals.select(F.inline("steps"), "null_rows")

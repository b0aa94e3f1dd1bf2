"""What several operators share: tables, staging, and the words of a text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}  # folders of sessions that name none


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of our own in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="textprep-llm-")
    return _own[context.applicationId]


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage.

    Parquet, so that later steps read only the columns they use and lost executors cost a
    re-read. The shuffles of the write are removed with its end, as the table holds their result.
    The folder's owner removes the table with the run, unless ``release`` did before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove staged tables of which all that was derived is staged itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are bounded by bytes, unless the session says how large they may be."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(setting).rstrip("b")) == (1 << 31) - 1:  # Spark's own
        spark.conf.set(setting, str(16 << 20))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """The \\n-separated lines of a text, empty ones included."""
    return F.split(text, "\n", -1)


def words_of(line: Column) -> Column:
    """The words of a text: maximal runs of characters other than ASCII white space.

    Splitting at one plain character is several times as fast as at a pattern, so the rarer
    white space is turned into spaces first, where there is any.
    """
    rarer = F.lit(False)
    for character in "\t\n\x0b\x0c\r":  # looked for byte by byte, without a pattern
        rarer = rarer | F.contains(line, F.lit(character))
    plain = F.when(rarer, F.translate(line, "\t\n\x0b\x0c\r", "     ")).otherwise(line)
    return F.array_remove(F.split(plain, " ", -1), "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)

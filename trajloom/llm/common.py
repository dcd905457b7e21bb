"""What the training-data operators share: table access, whole texts, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the text, null read as empty; every other column is left out."""
    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def hash_sample(values: DataFrame, n: int) -> list[str]:
    """The n distinct values (one string column) of the smallest hashes, in their order: bounded, over all rows, and the same however rows are dealt.

    Each task keeps n at most, so do 32 tasks on what those kept; n of these come to the driver.
    """
    def least(batches):
        kept: dict[int, str] = {}
        for b in batches:
            for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kept[h] = min(x, kept.get(h, x))
            if len(kept) > 4 * n:
                kept = dict(sorted(kept.items())[:n])
        some = sorted(kept.items())[:n]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([x for _, x in some], pa.string())], ["h", "x"])

    found = values.toDF("x").filter(F.col("x").isNotNull()).select(F.xxhash64("x").alias("h"), "x").mapInArrow(least, "h bigint, x string")
    found = found.repartition(32, "h").mapInArrow(least, "h bigint, x string")
    return [r["x"] for r in found.orderBy("h").limit(n).collect()]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and everything runs on this machine (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's own switch: a query's shuffle files go when it ends, not when the driver next collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trajloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder: later jobs and lost executors read it again from there."""
    return _write(df)[0]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``written`` for tables that are of no use after the block: they are deleted when it ends well. What leaves the block must be written itself."""
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        table, path = _write(df)
        paths.append(path)
        return table

    yield keep
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(hadoop).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

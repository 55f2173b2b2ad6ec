"""What the operators of this subpackage share on Spark's side."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 2_000
BATCH_BYTES = 4 << 20
#: Rows that Parquet's reader decodes at once; its vectors hold all their texts, and grow by doubling.
READER_ROWS = 256

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, on a local master, as in tests) a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _own.setdefault(spark.sparkContext.applicationId, "")
        if not where:
            where = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return where.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of Parquet's reader, and to and from Python, hold at most so many rows and bytes from now on, so long texts don't fill an executor."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READER_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under one of this application's."""
    return f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes everything that ``cut`` and the operators have written in this application; call it when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there.

    The files outlive any executor, so what follows never has to run df again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


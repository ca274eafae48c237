"""Tables that every executor and the driver can read, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    It is set here only where it is unset and the master is local, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gramwell-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gramwell-{uuid.uuid4().hex[:12]}/{tag}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends here."""
    path = work_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that written() made, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size, taken from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int, least: int = 8) -> int:
    """How many partitions make pieces of about bytes_each of the files under df.

    Where Spark has no estimate (rows that come from no file), the session's number of shuffle partitions.
    """
    size = input_bytes(df)
    n = size // max(1, bytes_each) + 1 if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, min(n, 200_000)))


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Bounds the rows of an Arrow batch in this session, so that few whole texts are held at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))

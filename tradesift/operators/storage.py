"""Tables in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, one of our own in local mode (tests); a cluster without it is an error, since
    machine-local folders are lost with their machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tradesift-')}")


_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends in the checkpoint folder that all executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; the folder goes with the application."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tradesift/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    found = spark.read.schema(df.schema).parquet(path.toString())
    found._stored_at = path
    return found


def discard(*dfs: DataFrame | None) -> None:
    """Folders of what ``stored`` returned go, once nothing that is still to run reads them."""
    for df in filter(None, dfs):
        df._stored_at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(df._stored_at, True)

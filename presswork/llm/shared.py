"""Reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Batches of rows for Python workers are bounded by bytes, not by rows alone: long texts would make them as large as they are long.

    Sets the session's limit if it is above BATCH_BYTES; results don't depend on it.
    """
    if int((spark.conf.get(_BATCH, None) or "0b").rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set a local session gets a temporary folder; a cluster, whose
    executors wouldn't see it, an error."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not have:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="presswork-")
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps read it again and don't depend on executors that are gone."""
    spark = bounded_batches(df.sparkSession)
    path = f"{shared_folder(spark)}/presswork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing that is still to be computed reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return df.select(*names)

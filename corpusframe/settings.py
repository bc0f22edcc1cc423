"""Session settings, the shared folder and stored tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a job should start from. Nothing here depends on the data size except through AQE.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def session(app: str = "corpusframe", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made, and set, only where none is named, which is the case in local tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder.

    Used where a result is read by several branches of a plan: the branches then read the columns
    they need from the table instead of computing everything again, and a lost executor costs a
    read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nobody holds any more, as it does whenever the driver collects garbage; with much
    memory it does so too rarely, and the files of steps long written pile up on the executors' disks."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def drop_stage(df: DataFrame) -> None:
    """Removes a table that ``durable`` wrote, once its last reader has been written itself. Of other frames nothing is removed."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    if len(paths) == 1 and f"{folder.split(':', 1)[-1].rstrip('/')}/stage-" in (path := paths.pop()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

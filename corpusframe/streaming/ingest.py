"""Incremental ingest of chunks from a file stream into a stored table.

The table is cut into buckets by a hash of the id, and a commit log names the versions (one a batch) that it
holds. A batch reads the ids of its own buckets only, and only those of committed versions.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusframe.sources import commits

BUCKETS = 64
VERSION, BUCKET, BASE = "__version", "__bucket", "base"


def _live(spark: SparkSession, table_path: str) -> list[str]:
    """Committed versions since the last one that replaced all before it."""
    names = commits.versions(spark, table_path)
    bases = [i for i, n in enumerate(names) if n.split("-")[1] == BASE]
    return names[bases[-1]:] if bases else names


def stored(spark: SparkSession, table_path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """The committed rows, of ``buckets`` only if given, with their bucket in ``__bucket``."""
    full = T.StructType([*schema.fields, T.StructField(VERSION, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    names = _live(spark, table_path)
    if not names:
        return spark.createDataFrame([], full).drop(VERSION)
    rows = spark.read.schema(full).option("basePath", table_path).parquet(*[f"{table_path}/{VERSION}={n}" for n in names])
    return (rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))).drop(VERSION)


def _write(rows: DataFrame, table_path: str, version: str) -> None:
    # a version that was begun and not committed is written again from its start
    rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{table_path}/{VERSION}={version}")
    commits.commit(rows.sparkSession, table_path, version)


def ingest_stream(stream: DataFrame, table_path: str, checkpoint: str, order: list[str], key: str = "chunk_id", buckets: int = BUCKETS):
    """Start a query that appends the chunks whose id is not stored yet; the first by ``order`` wins.

    Rows without an id are left out. A batch that is replayed after a failure finds its version committed and adds
    nothing, or writes it anew. ``buckets`` belongs to the table: another number than its versions have is an error.
    Read the table with ``stored``. Returns the running query.
    """
    schema = stream.schema
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def add(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, f"{buckets}-{run}-{number}"
        names = commits.versions(spark, table_path)
        if version in names:
            return
        if any(n.split("-")[0] != str(buckets) for n in names):
            raise ValueError(f"{table_path} has {names[0].split('-')[0]} buckets, not {buckets}")
        own = batch.filter(F.coalesce(key, F.lit("")) != "").withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        hit = [r[0] for r in own.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
        first = own.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")
        old = stored(spark, table_path, schema, hit).select(BUCKET, key)
        _write(first.join(old, [BUCKET, key], "left_anti").select(*schema.names, BUCKET), table_path, version)

    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def compact(spark: SparkSession, table_path: str, schema: T.StructType) -> None:
    """Replaces the versions by one, so that a bucket is few files again. Not beside a running ingest.

    The replaced versions are removed after the commit; a reader that still holds them must have ended.
    """
    old = _live(spark, table_path)
    if len(old) > 1:
        _write(stored(spark, table_path, schema), table_path, f"{old[0].split('-')[0]}-{BASE}-{uuid.uuid4().hex}")
        for name in old:
            commits.remove(spark, f"{table_path}/{VERSION}={name}")

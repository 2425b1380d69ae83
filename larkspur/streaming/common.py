"""Shared plumbing of the streams: per-batch folders make a replay harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stash


def stream_files(spark: SparkSession, folder: str, schema, fmt: str = "parquet",
                 max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


KEY_BUCKETS = 256


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def earlier(spark: SparkSession, target: str, batch_id: int) -> DataFrame | None:
    """What batches before this one wrote; None before the first."""
    if not exists(spark, target):
        return None
    return spark.read.parquet(target).where(F.col("batch_id") < batch_id)


def _key_bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def known_keys(batch: DataFrame, target: str, batch_id: int, key: str) -> DataFrame | None:
    """Keys of earlier batches from the key ledger beside the table; only the hash
    buckets that keys of this batch fall in are read."""
    spark = batch.sparkSession
    if not exists(spark, f"{target}/_keys"):  # a table from before there was a ledger
        older = earlier(spark, target, batch_id)
        return None if older is None else older.select(key)
    buckets = [r[0] for r in batch.select(_key_bucket(key)).distinct().collect()]  # at most KEY_BUCKETS
    return (spark.read.parquet(f"{target}/_keys")
            .where((F.col("batch_id") < batch_id) & F.col("bucket").isin(buckets)).select(key))


def unseen(batch: DataFrame, target: str, batch_id: int, key: str) -> DataFrame:
    """Batch rows whose key no earlier batch brought.  The ledger's keys are first met
    with the batch's own: its stored key list is small, so that pass is a broadcast
    over the opened buckets instead of a shuffle of them."""
    mine = stash(batch.select(key).where(F.col(key).isNotNull()).distinct(), "keys")
    known = known_keys(mine, target, batch_id, key)
    if known is None:
        return batch
    return batch.join(known.join(mine, key, "left_semi"), key, "left_anti")


def write_batch(df: DataFrame, target: str, batch_id: int, key: str | None = None) -> None:
    """A batch owns one folder: repeating it overwrites its own rows only.  With
    ``key`` its keys go to the ledger, after the rows."""
    folder = f"{target}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(folder)
    if key is not None:
        written = df.sparkSession.read.parquet(folder).select(key).where(F.col(key).isNotNull())
        (written.withColumn("bucket", _key_bucket(key)).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{target}/_keys/batch_id={batch_id}"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything there is and stop; the scheduler calls this again."""
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())

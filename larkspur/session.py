"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "larkspur", **conf: str) -> SparkSession:
    """A session with the settings this library expects.  Master, memory and
    partition counts are left to spark-submit unless passed in ``conf``."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` when set.  Only
    a local master may fall back to a temporary folder of this machine."""
    global _local_dir
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="larkspur-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/larkspur/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as parquet and read it back.  Cuts the lineage at a
    node that several consumers share, survives lost executors, and gives the
    optimizer true sizes for its later broadcast decisions."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

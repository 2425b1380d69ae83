"""Tables that grow by runs: append-only parquet folders under a manifest.

A run writes a folder of its own.  Only after that has succeeded a new numbered
manifest, which lists the folders that make up the table, is put in place by one
rename.  Readers take the newest manifest, so they see a table before or after a
run and never in between; a run that dies leaves a folder nobody lists.  Nothing
is overwritten: a rebuild lists its one new folder instead of the old ones, even
when it reads the table it replaces.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another run was committed in the meantime; nothing was lost."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop.Path, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, table: str) -> list[int]:
    _, fs, p = _fs(spark, f"{table}/_manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def folders(spark: SparkSession, table: str, version: int | None = None) -> list[str]:
    """Folder names that make up the table, oldest first."""
    known = _versions(spark, table)
    if not known:
        return []
    name = f"{table}/_manifest/{known[-1] if version is None else version:012d}.json"
    line, = spark.read.text(name).collect()
    return json.loads(line[0])


def _commit(spark: SparkSession, table: str, names: list[str], after: int) -> None:
    Path, fs, _ = _fs(spark, table)
    final = Path(f"{table}/_manifest/{after + 1:012d}.json")
    draft = Path(f"{table}/_manifest/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(names).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"{table}: version {after + 1} exists already")


def _write(df: DataFrame, table: str, partition_by: list[str] | None) -> str:
    name = f"run-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{table}/{name}")
    return name


def read(spark: SparkSession, table: str, names: list[str] | None = None) -> DataFrame | None:
    """The table, or the given runs of it; None if there are none."""
    names = folders(spark, table) if names is None else names
    if not names:
        return None
    parts = [spark.read.parquet(f"{table}/{n}") for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def append(df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
    """Adds a run and returns its rows."""
    spark = df.sparkSession
    version = (_versions(spark, table) or [0])[-1]
    listed = folders(spark, table)
    name = _write(df, table, partition_by)
    _commit(spark, table, [*listed, name], version)
    return spark.read.parquet(f"{table}/{name}")


def replace(df: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
    """A rebuild: the new rows are the whole table.  ``df`` may read the table."""
    spark = df.sparkSession
    version = (_versions(spark, table) or [0])[-1]
    name = _write(df, table, partition_by)
    _commit(spark, table, [name], version)
    return spark.read.parquet(f"{table}/{name}")


def grow(source: DataFrame, table: str, key: str, transform: Callable[[DataFrame], DataFrame],
         full_refresh: bool = False) -> DataFrame:
    """Transforms the source rows whose key the table lacks and appends them; with
    ``full_refresh`` all rows, as a rebuild.  Returns the table."""
    spark = source.sparkSession
    known = None if full_refresh else read(spark, table)
    if known is None:
        return replace(transform(source), table)
    todo = source.join(known.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    append(transform(todo), table)
    return read(spark, table)


def sweep(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Removes folders that the newest ``keep`` manifests do not list, with older
    manifests.  Call it when no run is under way; returns the folders removed."""
    Path, fs, p = _fs(spark, table)
    known = _versions(spark, table)
    if not known:
        return []
    listed = {n for v in known[-keep:] for n in folders(spark, table, v)}
    gone = [s.getPath().getName() for s in fs.listStatus(p)
            if s.getPath().getName().startswith("run-") and s.getPath().getName() not in listed]
    for name in gone:
        fs.delete(Path(f"{table}/{name}"), True)
    for v in known[:-keep]:
        fs.delete(Path(f"{table}/_manifest/{v:012d}.json"), False)
    return sorted(gone)

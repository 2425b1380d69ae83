"""Joins and scans that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 0.005  # a key above this share is split; hence at most 200 hot keys
TRACKED = 10_000  # keys a task's frequent-items sketch holds
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Every key owning at least ``share`` of the rows, from one scan of the key
    column: tasks keep frequent-items sketches that merge.  A sketch never counts
    a key too low and at most 3.5/2^14 of the rows too high, so a key just under
    the share may come too; it is only split needlessly.  The list is bounded by
    the share, whatever the data."""
    most = int(2 / share)
    top, total = df.agg(F.expr(f"approx_top_k(`{key}`, {most}, {max(TRACKED, most)})"),
                        F.count(F.lit(1))).first()
    return [r["item"] for r in top or [] if r["item"] is not None and r["count"] >= max(2, share * total)]


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
                row_id: str = "review_id", salts: int = SALTS,
                share: float = HOT_SHARE, hot: list | None = None) -> DataFrame:
    """Equi-join of many left rows to few right rows per key.

    Rows of hot keys, and in outer joins rows without a key, are spread over
    ``salts`` sub-keys taken from a hash of ``row_id`` (a retried task gives the
    same rows); the right rows of hot keys are repeated once per sub-key.  Results
    are those of a plain join, and the optimizer may still broadcast the right
    side.  ``hot`` passes keys found before, so that several joins of one table
    scan it once; without any hot key this is a plain join.
    """
    if hot is None:
        hot = hot_keys(left, key, share)
    sub = F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")
    zero = F.lit(0)
    if how == "left":
        lost = F.when(F.col(key).isNull(), sub)
    else:
        left, lost = left.where(F.col(key).isNotNull()), F.lit(None).cast("int")
    if not hot:
        if how != "left":
            return left.join(right, key, how)
        return (left.withColumn("_salt", F.coalesce(lost, zero))
                .join(right.withColumn("_salt", zero), [key, "_salt"], how).drop("_salt"))
    is_hot = F.col(key).isin(*hot)
    l = left.withColumn("_salt", F.when(is_hot, sub).otherwise(F.coalesce(lost, zero)))
    spread = F.when(is_hot, F.sequence(zero, F.lit(salts - 1))).otherwise(F.array(zero))
    r = right.where(F.col(key).isNotNull()).withColumn("_salt", F.explode(spread))
    return l.join(r, [key, "_salt"], how).drop("_salt")


def last_before(df: DataFrame, group: str, position: str, value: Column, name: str,
                block: int = 1000) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` at an earlier position of the
    same group.  Long groups are scanned in blocks of positions; what a block
    passes on to later ones is carried by a second, ``block`` times smaller scan."""
    d = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(position) / block))
    inner = (Window.partitionBy(group, "_b").orderBy(position)
             .rowsBetween(Window.unboundedPreceding, -1))
    outer = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col("_v").isNotNull()
    carry = (d.groupBy(group, "_b")
             .agg(F.max_by(F.col("_v"), F.when(seen, F.col(position))).alias("_last"))
             .withColumn("_carry", F.last("_last", ignorenulls=True).over(outer))
             .select(group, "_b", "_carry"))
    local = d.withColumn("_local", F.last("_v", ignorenulls=True).over(inner))
    return (local.join(carry, [group, "_b"])
            .withColumn(name, F.coalesce("_local", "_carry"))
            .drop("_v", "_b", "_local", "_carry"))

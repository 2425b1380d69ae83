"""Merkle manifest of a table: a tree of hashes per source, a tree over the sources,
and for every row a proof that it belongs to the root.

H is the lower-case hex sha256 of its inputs one after the other, digests as hex
text.  A leaf is H of doc_id, source, lang, n_chars and text, each ``-`` if null,
else its length in UTF-8 bytes, ``:`` and the value.  The leaves of a source ascend
by doc_id (nulls first, ties by hash); while a source has several nodes, every run
of ``arity`` consecutive ones, the last run perhaps shorter, becomes their H.  The
roots of the sources, null source first and then by UTF-8 bytes, form one more such
tree.  Each level equijoins its nodes with the places of their siblings (place XOR 1
for two, slot offsets otherwise), and rows in slot zero emit the parents.  Proofs go
down the same levels, so each level joins a third of the rows of the one below.

Only DataFrame functions are used.  Places come from a range partitioning with counts
per task, so no source is gathered anywhere.

Defined results: an empty table has an empty manifest and no root.  Repeated rows are
leaves of their own, side by side.  A null doc_id sorts first and is never tampered
with.  Texts of any length are hashed whole.  Further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, stash_with

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H of columns of text; null parts are skipped."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**changed: Column) -> Column:
    """Leaf digest of a row of ``documents``; ``changed`` replaces fields."""
    return digest(*[framed(changed.get(name, F.col(name))) for name in FIELDS])


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their place (from 0) in their group in the given order.  Ranges
    of (group, order) are numbered task by task; only the first group of a range can
    have begun in earlier ones, so one offset per range is enough."""
    part = stash(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                 .withColumn("_part", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
               .where("_before > 0").select("_part", group, "_before"))
    inside = Window.partitionBy("_part", group).orderBy(*order)
    return (part.withColumn("_row", F.row_number().over(inside))
            .join(F.broadcast(offsets), ["_part", group], "left")
            .withColumn("place", F.col("_row") - 1 + F.coalesce("_before", F.lit(0)))
            .drop("_part", "_row", "_before"))


def siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (grp, place, h) with the digests before and after each one in its run,
    and in slot zero the parent's digest (null for a group's only node)."""
    further = [c for c in nodes.columns if c not in ("grp", "place", "size", "h")]
    out = nodes.withColumn("slot", F.expr(f"place % {arity}"))
    for k in range(1, arity):
        at = F.expr("place ^ 1") if arity == 2 else F.expr(
            f"place - place % {arity} + (place % {arity} + {k}) % {arity}")
        other = nodes.select("grp", F.col("place").alias("_at"), F.col("h").alias(f"_s{k}"))
        out = out.withColumn("_at", at).join(other, ["grp", "_at"], "left").drop("_at")

    def by_slot(j):
        return F.element_at(F.array(*[F.col(f"_s{k}") for k in range(1, arity)]),
                            F.expr(f"cast((({j} - slot) % {arity} + {arity}) % {arity} as int)"))

    none = F.lit(None).cast("string")
    before = F.concat_ws("", *[F.when(F.lit(j) < F.col("slot"), by_slot(j)).otherwise(none)
                               for j in range(arity - 1)])
    after = F.concat_ws("", *[F.when(F.lit(j) > F.col("slot"), by_slot(j)).otherwise(none)
                              for j in range(1, arity)])
    out = out.withColumn("before", before).withColumn("after", after)
    parent = F.when((F.col("slot") == 0) & (F.col("size") > 1), digest("h", "after"))
    return out.select("grp", "place", "size", "h", "before", "after", parent.alias("parent"), *further)


def levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Stored levels of the trees of all groups, from the leaves (grp, place, size, h)
    upward, where size is the number of nodes of the group on that level."""
    out, nodes = [], leaves
    while True:
        level, seen = stash_with(siblings(nodes, arity), "level", n=F.count(F.lit(1)),
                                 top=F.max("size"))
        out.append(level)
        if not seen["n"] or seen["top"] == 1:
            return out
        nodes = level.where("parent is not null").select(
            "grp", F.expr(f"place div {arity}").alias("place"),
            F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), F.col("parent").alias("h"))


def proofs(tree: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """(h, subroot, path) of the lowest level with its further columns; ``above`` has
    (grp, path) of each group's root.  A path is the siblings before and after the node,
    upward."""
    step = F.array(F.struct("before", "after"))
    known = None
    for depth in range(len(tree) - 1, -1, -1):
        level = tree[depth]
        names = ["grp", "place", "h"]
        names += [c for c in level.columns if c not in (*names, "size", "before", "after", "parent")]
        at_root = (level.where("size = 1").join(above, "grp")
                   .select(*names, F.col("h").alias("subroot"), "path"))
        if known is not None:
            parents = known.select("grp", F.col("place").alias("_up"), "subroot", "path")
            below = (level.where("size > 1").withColumn("_up", F.expr(f"place div {arity}"))
                     .join(parents, ["grp", "_up"])
                     .select(*names, "subroot", F.concat(step, "path").alias("path")))
            at_root = at_root.unionByName(below)
        known = stash(at_root, "paths") if depth else at_root
    return known


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(docs: DataFrame, arity: int = 3, altered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from the leaf
    of the row as ``altered`` says its text now is (by default as it is)."""
    text = F.col("text") if altered is None else altered
    rows = stash(docs.select("doc_id", F.when(F.col("source").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("+"), F.col("source").cast("string"))).alias("grp"),
        leaf().alias("h"), leaf(text=text).alias("now")), "rows")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    tree = levels(placed(rows, "grp", ["doc_id", "h", "now"]).join(sizes, "grp"), arity)
    roots = tree[0].where("size = 1").select("grp", "h")
    for level in tree[1:]:
        roots = roots.unionByName(level.where("size = 1").select("grp", "h"))
    roots = placed(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"),
                   "grp", ["name"])
    high = levels(roots.withColumn("size", F.lit(sizes.count())), arity)
    no_steps = F.array().cast("array<struct<before:string,after:string>>")
    root = high[-1].select("h").first()
    above = stash(proofs(high, high[-1].select("grp", no_steps.alias("path")), arity)
                  .select(F.col("name").alias("grp"), "path"), "root-paths")
    folded = fold(F.col("now"), F.col("path"))
    proof = digest(F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    return (proofs(tree, above, arity)
            .select("doc_id", F.col("h").alias("leaf"), "subroot",
                    F.lit(root and root[0]).cast("string").alias("root"),
                    proof.alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def without_newlines() -> Column:
    """The tampering of the contract: rows whose doc_id has an even crc32 lose the
    newlines of their text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))

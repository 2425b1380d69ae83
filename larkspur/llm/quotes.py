"""Quotation linking: conversations in reply order, without their quotes.

Every line has a quote level, the number of ``>`` before it.  Lines of one level with no
other line between them are a passage.  A passage is normalised (lower case, single
blanks, line breaks too, so that wrapping does not matter) and hashed by its shingles of
five words, and by its lines of fewer words.  Within a conversation these meet the first
earlier message that has them in its own text, and the message that accounts for most
words of a passage, half of its weight at least, is its source; the later message on a
tie.  The source of the heaviest passage of level 1 is the parent (of deeper levels, if
level 1 finds none).  Roots and depths follow by pointer doubling; sorting by
``root_turn``, ``depth`` and ``turn`` gives the conversation in reply order.  DataFrame
functions only.

Defined results: a null or empty text has no lines and an empty clean text.  Blank
passages are never linked.  Messages that quote nothing, or nothing known, start a
thread.  A quoted fragment of fewer than five words links only if it is a whole line.
Rows that repeat (conv_id, turn) are all kept and take the parent of all.  Rows with a
null conv_id or turn are kept without links.  Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, stash_with

MARKS = r"^[ \t]*((?:>[ \t]?)*)"


def lines(text: str = "text"):
    """Lines of a text as (level, line without its quote marks)."""
    def parts(x):
        marks = F.regexp_extract(x, MARKS, 1)
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
                        F.when(marks == "", x).otherwise(F.regexp_replace(x, MARKS, "")).alias("line"))

    split = F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)
    return F.transform(split, parts)


WORDS = 5
GAP = "\x01"


def _clean(text):
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _hashed(text, k: int = WORDS):
    """Hashes of a text, each with the words it stands for: shingles of ``k`` words, and
    lines of fewer."""
    words = F.filter(F.split(_clean(text), " "), lambda w: w != "")
    runs = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - k + 1)),
                                lambda i: i + k - 1 <= F.size(words)),
                       lambda i: F.struct(F.xxhash64(F.array_join(F.slice(words, i, k), " ")).alias("h"),
                                          F.lit(k).alias("weight")))
    short = F.transform(F.split(text, "\n"), lambda x: F.struct(
        F.xxhash64(_clean(x)).alias("h"),
        F.when(_clean(x) == "", 0).otherwise(F.size(F.split(_clean(x), " "))).alias("weight")))
    return F.array_distinct(F.concat(runs, F.filter(short, lambda x: (x.weight > 0) & (x.weight < k))))


def passages(text: str = "text"):
    """(level, passage) of the quotes of a text, lines joined by line breaks."""
    parts = lines(text)
    levels = F.filter(F.array_distinct(F.transform(parts, lambda x: x.level)), lambda n: n > 0)

    def of_level(n):
        marked = F.array_join(F.transform(parts, lambda x: F.when(x.level == n, x.line).otherwise(GAP)), "\n")
        return F.transform(F.filter(F.split(marked, GAP), lambda run: _clean(run) != ""),
                           lambda run: F.struct(n.alias("level"), run.alias("passage")))

    return F.flatten(F.transform(levels, of_level))


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent) of messages whose quotes are found earlier."""
    known = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "text")
    quoted = (known.where(F.col("text").contains(">"))
              .select("conv_id", "turn", F.posexplode(passages()).alias("at", "x"))
              .select("conv_id", "turn", "at", "x.level", _hashed(F.col("x.passage")).alias("_g"))
              .withColumn("weight_all", F.aggregate("_g", F.lit(0), lambda t, g: t + g.weight))
              .select("conv_id", "turn", "at", "level", "weight_all", F.inline("_g")))
    quoted = stash(quoted, "quoted")
    own_lines = F.filter(lines(), lambda x: x.level == 0)
    own_text = F.array_join(F.transform(own_lines, lambda x: x.line), "\n")
    # only conversations with quotes; a line that many messages have counts for its first
    own = (known.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
           .select("conv_id", "turn", F.explode(_hashed(own_text)).alias("g"))
           .groupBy("conv_id", F.col("g.h").alias("h")).agg(F.min("turn").alias("parent")))
    votes = (quoted.join(own, ["conv_id", "h"]).where("parent < turn")
             .groupBy("conv_id", "turn", "at", "level", "parent")
             .agg(F.sum("weight").alias("votes"), F.max("weight_all").alias("weight_all"))
             .where("2 * votes >= weight_all"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.max(F.struct((F.col("level") == 1).alias("direct"), "votes", "parent")).alias("_b"))
    return best.select("conv_id", "turn", F.col("_b.parent").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth); each round doubles the way covered."""
    now, left = stash_with(
        links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")),
        "threads", moved=F.count(F.lit(1)))
    while left["moved"]:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"),
                        F.col("depth").alias("more"))
        now, left = stash_with(
            now.join(up, ["conv_id", "root"], "left").select(
                "conv_id", "turn", "parent", F.coalesce("up", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("up").isNotNull().alias("moved")), "threads", moved=F.count_if("moved"))
        now = now.drop("moved")
    return now


def conversations(messages: DataFrame) -> DataFrame:
    """Every message with its parent, thread, depth and text without quotes."""
    found = threads(parents(messages))
    own = F.filter(lines(), lambda x: x.level == 0)
    quoted = F.size(lines()) - F.size(own)
    clean = F.trim(F.array_join(F.transform(own, lambda x: x.line), "\n"))
    out = messages.select("conv_id", "turn", "role", clean.alias("clean_text"),
                          quoted.cast("long").alias("n_quoted_lines"))
    return out.join(found, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("parent").alias("reply_to"),
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted_lines", "clean_text")

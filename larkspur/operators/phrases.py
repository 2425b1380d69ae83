"""Finds the phrases of a dictionary in texts by equi-joining hashed token runs.

A text is cut into tokens: words, and every other character by itself.  A phrase
stands in a text as whole words exactly where a run of as many tokens equals it, so
each text emits the hashes of its token runs of the lengths that occur in the
dictionary, and these join the hashes of the phrases.  Any number of phrases works;
the dictionary is never gathered into one row, task or broadcast by this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .skew import spread_join

WORD = r"[\p{L}\p{N}_]+"
TOKEN = WORD + r"|[^\p{L}\p{N}_]"


def _tokens(column: str):
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """(phrase, length, h): lower-cased distinct phrases, their tokens and hash."""
    phrase = F.trim(F.lower(column))
    return (terms.select(phrase.alias("phrase")).where(F.col("phrase") != "").distinct()
            .withColumn("length", F.size(_tokens("phrase"))).withColumn("h", F.xxhash64("phrase")))


def token_runs(texts: DataFrame, row_id: str, body: str, lengths: list[int]) -> DataFrame:
    """(row_id, h) of every distinct run of tokens of the given lengths that begins
    and ends at the edge of a word or beside another character."""
    t = texts.select(row_id, _tokens(body).alias("_t"))
    t = t.withColumn("_w", F.expr(rf"transform(_t, x -> x rlike '^[\\p{{L}}\\p{{N}}_]')"))
    runs = [F.expr(f"""transform(filter(sequence(0, greatest(0, size(_t) - {n})), i ->
        i + {n} <= size(_t) and _t[i] <> ' ' and (_w[i] or i = 0 or not get(_w, i - 1))
        and (_w[i + {n - 1}] or i + {n} = size(_t) or not get(_w, i + {n}))),
        i -> xxhash64(array_join(slice(_t, i + 1, {n}), '')))""") for n in lengths]
    return t.select(row_id, F.explode(F.array_distinct(F.concat(*runs))).alias("h"))


def occurrences(texts: DataFrame, row_id: str, body: str, terms: DataFrame, column: str = "term") -> DataFrame:
    """(row_id, phrase) for every phrase that stands in a text as whole words.
    ``row_id`` must be unique; frequent runs are spread in the join."""
    known = stash(dictionary(terms, column), "phrases")
    # as many values as there are lengths of phrases, not phrases
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())
    if not lengths:
        return texts.select(row_id).where("false").withColumn("phrase", F.lit(""))
    runs = stash(token_runs(texts, row_id, body, lengths), "token-runs")
    met = spread_join(runs, known.select("h", "phrase"), "h", "inner", row_id=row_id)
    # the hash only finds candidates; the text itself decides
    return (met.select(row_id, "phrase").join(texts.select(row_id, F.lower(body).alias("_low")), row_id)
            .where(F.col("_low").contains(F.col("phrase"))).select(row_id, "phrase"))

"""Personal data: fixed patterns, and bootstrapped extraction from contexts.

Base kinds (email, ip, card, phone) are patterns with checks on the match.  They
seed a graph of patterns (the word before a token) and instances (tokens with
four digits or more).  A pattern is trusted by the share of its instances that are seeds or were
accepted; an instance is accepted by one minus the product of the distrust of its
patterns; this repeats.  Accepted tokens outside the base spans get kind ``context``.
DataFrame functions only.  Offsets count code points; ends are exclusive.

Defined results: null and empty texts have no spans.  Repeated rows are searched one
by one and count once as pattern and instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, stash

#: The contract's patterns.  A look-behind or the end of the last match (\G) stands
#: before runs, and runs are possessive, so that long runs take linear time.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: an identifier: a token with at least four digits
TOKEN = r"(?:\G|(?<!\S))(?=(?:[^\s0-9]*+[0-9]){4})\S++"
KINDS = ("email", "ip", "card", "phone", "context")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def value(i):
        x = F.substring(d, i, 1).cast("int") * (2 - i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def found(text: Column, pattern: str, need: str) -> Column:
    """Matches with their limits and the text before each: array of structs.
    need: what a text must contain to be searched at all."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,m:string,before:string>>)")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("p"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def step(state, x):
        s = state.at + F.length(x.p)
        e = s + F.length(x.m)
        hit = F.struct(s.alias("s"), e.alias("e"), x.m.alias("m"),
                       F.substring(x.p, -60, 60).alias("before"))
        return F.when(x.m.isNull(), state).otherwise(
            F.struct(e.alias("at"), F.concat(state.out, F.array(hit)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    hits = F.aggregate(pairs, start, step, lambda s: s.out)
    return F.when(text.rlike(need), hits).otherwise(none)


def _span_text(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x.s.cast("string"), F.lit(":"),
                                                 x.e.cast("string")))


def _valid(spans: Column, check) -> Column:
    return F.filter(spans, lambda x: check(x.m))


def base(docs: DataFrame) -> DataFrame:
    """uid, doc_id, base spans by kind, and identifier tokens, of every row."""
    text = F.coalesce("text", F.lit(""))
    cols = [_valid(found(text, p, need), CHECKS[kind]).alias(kind)
            for kind, p, need in (("email", EMAIL, "@"), ("ip", IP, r"[0-9]\.[0-9]"),
                                  ("card", CARD, "[0-9]"), ("phone", PHONE, r"\+[0-9]"))]
    left = F.transform(found(text, TOKEN, "[0-9]"), lambda x: F.struct(
        x.s.alias("s"), x.e.alias("e"), x.m.alias("m"),
        F.regexp_replace(F.lower(F.regexp_extract(x.before, r"(\S+)\s*$", 1)), "[0-9]", "0").alias("left")))
    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", *cols,
                       left.alias("tokens"))


def trusted(edges: DataFrame, rounds: int = 2, trust: float = 0.6, support: int = 3) -> DataFrame:
    """Accepted instances of a graph (left, m, seed), none of them a seed."""
    known = edges.withColumn("pos", F.col("seed"))
    accepted = None
    for _ in range(rounds):
        patterns = stash(known.groupBy("left").agg(
            F.avg(F.col("pos").cast("int")).alias("conf"), F.count_if("pos").alias("n"),
            F.count(F.lit(1)).alias("edges")), "patterns")
        scored = lookup_join(edges, patterns, ["left"], "edges")
        doubt = F.sum(F.log1p(-F.least(F.when(F.col("n") >= support, F.col("conf")).otherwise(0.0),
                                       F.lit(0.999))))
        accepted = stash(scored.groupBy("m").agg((1 - F.exp(doubt)).alias("score"), F.count(F.lit(1)).alias("edges"),
                                                 F.max("seed").alias("is_seed"))
                         .where((F.col("score") >= trust) & ~F.col("is_seed")).select("m", "edges"), "accepted")
        known = lookup_join(edges, accepted.withColumn("new", F.lit(True)), ["m"], "edges").withColumn(
            "pos", F.col("seed") | F.coalesce("new", F.lit(False)))
    return accepted.select("m")


def find(docs: DataFrame, rounds: int = 2, trust: float = 0.6, support: int = 3) -> DataFrame:
    """doc_id, counts of base kinds, their digest, and all spans, of every row."""
    rows = stash(base(docs), "personal")
    inside = F.exists(F.concat("email", "ip", "card", "phone"),
                      lambda b: (b.s < F.col("t.e")) & (b.e > F.col("t.s")))
    seen = rows.select("uid", "email", "ip", "card", "phone", F.explode("tokens").alias("t")).select(
        "uid", "t.s", "t.e", "t.m", "t.left", inside.alias("seed"))
    seen = stash(seen, "occurrences")
    edges = stash(seen.where("left <> ''").groupBy("left", "m").agg(F.max("seed").alias("seed")), "graph")
    good = trusted(edges, rounds, trust, support)
    free = seen.where("not seed")
    count = stash(free.groupBy("m").agg(F.count(F.lit(1)).alias("n")).join(good, "m")
                  .withColumn("good", F.lit(True)), "unseen")
    more = (lookup_join(free, count, ["m"], "n").where("good").groupBy("uid")
            .agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("context")))
    kinds = KINDS[:4]
    text = [_span_text(k, F.col(k)) for k in kinds]
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return rows.drop("tokens").join(more, "uid", "left").select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(F.array_join(F.concat(*text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*text, _span_text("context", F.coalesce("context", none))), ",").alias("spans"))

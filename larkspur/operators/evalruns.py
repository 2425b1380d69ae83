"""Evaluation-run analytics: summaries, percentiles, routing, cost, winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.numeric import TIE, mean_of, share_of, steady_round
from ..session import stash
from .dedup import top_n


def question_type(qid: Column) -> Column:
    prefix = F.when(F.instr(qid, "_") > 0, F.split_part(qid, F.lit("_"), F.lit(1))).otherwise(qid)
    out = None
    for key, label in vocab.QUESTION_TYPES.items():
        out = (F.when if out is None else out.when)(prefix == key, F.lit(label))
    return out.otherwise(F.lit("unknown"))


def routing_correct(actual: Column, expected: Column, tools: Column) -> Column:
    """Exact intent, or an agent that used a tool fitting the intent."""
    agentic = (actual == "agent") | actual.startswith("structured")
    fits = (((expected == "structured") & (F.array_contains(tools, "query_analyst")
                                           | F.array_contains(tools, "structured")))
            | ((expected == "semantic") & F.array_contains(tools, "search_reviews"))
            | ((expected == "synthesis") & (F.size(tools) >= 2)))
    return F.coalesce((actual == expected) | (agentic & fits), F.lit(False))


def calls(intent: Column, tools: Column, reflection: Column, fallback: Column) -> Column:
    """Model calls a question took, from the path it went."""
    legacy = (F.when(intent.contains("structured"), 0).when(intent.contains("semantic"), 1).otherwise(2))
    plain = (F.size(tools) == 1) & F.array_contains(tools, "structured")
    agent = (intent == "agent") | ((F.size(tools) > 0) & ~plain)
    return (F.when(fallback, legacy).when(agent, F.when(reflection, 3).otherwise(2)).otherwise(1))


def with_costs(runs: DataFrame, per_call: float = vocab.COST_PER_CALL) -> DataFrame:
    n = calls(F.col("actual_intent"), F.col("tools_used"), F.col("has_reflection"), F.col("fallback_used"))
    return (runs.withColumn("llm_calls", n)
            .withColumn("estimated_cost", F.round(F.col("llm_calls") * per_call, 4).cast("decimal(10,4)"))
            .withColumn("query_path", F.when(F.col("fallback_used"), F.concat(F.lit("legacy_"), "actual_intent"))
                        .otherwise("agent")))


def prepared(runs: DataFrame) -> DataFrame:
    """Runs with routing verdict, cost and question type."""
    return with_costs(runs.withColumn("intent_correct", routing_correct(
        F.col("actual_intent"), F.col("expected_intent"), F.col("tools_used")))).withColumn(
        "question_type", question_type(F.col("question_id")))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int],
                 part: int = 50_000, fan: int = 64) -> DataFrame:
    """``sorted(values)[min(int(n * p / 100), n - 1)]`` per key, exact.

    Equal values are counted first.  While a key has more than ``part`` distinct values
    left, a round takes ``fan`` splitters from a quantile sketch of them, counts exactly
    between the splitters and keeps only what lies where a wanted position falls.  So
    no task sorts more than ``part`` values, however they are spread.
    """
    rows = stash(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
                 .agg(F.count(F.lit(1)).alias("_n")), "values")
    total = F.col("_all")
    wanted = rows.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(p).alias("percent"), F.least(F.floor(total * p / 100), total - 1).alias("_at"))
        for p in percents])))
    by = list(keys)
    while (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d")).first()[0] or 0) > part:
        cuts = F.percentile_approx("_v", [i / fan for i in range(1, fan)], 100 * fan)
        # one row per key; stored, so that the join knows its size
        splitters = stash(rows.groupBy(*by).agg(F.array_distinct(cuts).alias("_s")), "splitters")
        marked = stash(rows.join(splitters, by).withColumn(
            "_b", F.size(F.filter("_s", lambda s: s < F.col("_v")))).drop("_s"), "marked")
        up = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        buckets = (marked.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
                   .withColumn("_end", F.sum("_bn").over(up)))
        first = F.col("_end") - F.col("_bn")
        hit = stash(buckets.join(wanted, by).where((F.col("_at") < F.col("_end")) & (F.col("_at") >= first))
                    .select(*keys, "percent", "_b", (F.col("_at") - first).alias("_at")), "hits")
        meet = [*by, "_b"]
        rows = stash(marked.join(hit.drop("_at"), meet).select(*keys, "percent", "_v", "_n"), "left")
        wanted, by = hit.drop("_b"), [*keys, "percent"]
    inside = Window.partitionBy(*keys, "percent").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    fine = (rows.join(wanted, by).withColumn("_end", F.sum("_n").over(inside))
            .where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n"))))
    return fine.select(*keys, "percent", F.col("_v").alias("value"))


def _score_columns() -> list[Column]:
    return [mean_of(F.col(f"judge_{n}"), 4).alias(f"avg_{n}")
            for n in ("factuality", "completeness", "citation", "context")]


def model_summary(runs: DataFrame, keys: tuple[str, ...] = ("run_id", "model", "judge_model")) -> DataFrame:
    r = prepared(runs)
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("questions"), share_of(F.col("intent_correct"), 4).alias("intent_accuracy"),
        share_of(F.col("data_correct"), 4).alias("data_correctness"), *_score_columns(),
        share_of(F.col("is_hallucination"), 4).alias("hallucination_rate"),
        share_of(F.col("fallback_used"), 4).alias("fallback_rate"),
        mean_of(F.col("latency_s") * 1000, 2).alias("avg_latency_ms"),
        F.sum("estimated_cost").alias("total_cost"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Accuracies, score means, rates, P50/P95/P99 latency and cost per model."""
    keys = ["run_id", "model"]
    r = prepared(runs)
    base = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluated"), share_of(F.col("intent_correct"), 4).alias("intent_accuracy"),
        share_of(F.col("data_correct"), 4).alias("data_correctness"),
        *[mean_of(F.col(f"judge_{n}"), 2).alias(f"avg_{n}")
          for n in ("factuality", "completeness", "citation", "context")],
        F.count_if("is_hallucination").alias("hallucination_count"),
        share_of(F.col("is_hallucination"), 4).alias("hallucination_rate"),
        F.count_if("fallback_used").alias("fallback_count"),
        share_of(F.col("fallback_used"), 4).alias("fallback_rate"),
        mean_of(F.col("latency_s"), 2).alias("latency_avg"),
        mean_of(F.col("estimated_cost"), 4).alias("avg_cost_per_query"),
        steady_round(F.sum("estimated_cost"), 2).alias("total_eval_cost"))
    p = nearest_rank(r, keys, "latency_s", [50, 95, 99])
    wide = p.groupBy(*keys).agg(*[F.max(F.when(F.col("percent") == q, F.col("value"))).alias(f"latency_p{q}")
                                  for q in (50, 95, 99)])
    return base.join(wide, keys)


WINNER_METRICS = {"intent_accuracy": True, "data_correctness": True, "avg_factuality": True,
                  "avg_completeness": True, "avg_citation": True, "avg_context": True,
                  "hallucination_rate": False, "fallback_rate": False, "latency_p95": False,
                  "avg_cost_per_query": False}


def metric_winners(summary: DataFrame) -> DataFrame:
    """Best model per metric; the first model by name wins a tie."""
    args = ", ".join(f"'{m}', cast({m} as double)" for m in WINNER_METRICS)
    long = summary.select("model", F.expr(f"stack({len(WINNER_METRICS)}, {args}) as (metric, value)")).where(
        F.col("value").isNotNull())
    higher = F.col("metric").isin(*[m for m, up in WINNER_METRICS.items() if up])
    best = top_n(long, ["metric"], [F.when(higher, -F.col("value")).otherwise(F.col("value")), F.col("model")], 1)
    return best.select("metric", F.col("model").alias("winner"), "value")


def case_matrix(runs: DataFrame, models: list[str]) -> DataFrame:
    """Question x model.  The cell holds intent and data marks and scores of
    the question's first attempt."""
    first = top_n(prepared(runs), ["question_id", "model"], [F.col("event_id")], 1)
    mark = lambda c: F.when(F.col(c), "+").otherwise("-")
    cell = F.concat(F.lit("I"), mark("intent_correct"), F.lit(" D"), mark("data_correct"),
                    F.lit(" F"), F.col("judge_factuality").cast("string"),
                    F.lit(" C"), F.col("judge_citation").cast("string"), F.lit(" "),
                    F.array_join("tools_used", "/"))
    return (first.withColumn("_cell", cell).groupBy("question_id", "expected_intent")
            .pivot("model", models).agg(F.first("_cell")))


def intent_breakdown(runs: DataFrame) -> DataFrame:
    return prepared(runs).groupBy("expected_intent").agg(
        F.count(F.lit(1)).alias("questions"), share_of(F.col("intent_correct"), 4).alias("intent_accuracy"),
        mean_of(F.col("judge_factuality"), 2).alias("avg_factuality"))


def tool_counts(runs: DataFrame) -> DataFrame:
    return (runs.select(F.explode("tools_used").alias("tool")).groupBy("tool")
            .agg(F.count(F.lit(1)).alias("uses")).orderBy(F.col("uses").desc(), "tool"))


def path_counts(runs: DataFrame) -> DataFrame:
    return with_costs(runs).groupBy("query_path").agg(F.count(F.lit(1)).alias("questions"))


def tolerant_match(pairs: DataFrame, actual: str, expected: str, tolerance: float = 0.05) -> DataFrame:
    """Numbers within a relative tolerance; anything else as text without case."""
    a, e = F.col(actual).try_cast("double"), F.col(expected).try_cast("double")
    close = F.abs(a - e) / F.greatest(F.abs(e), F.lit(1e-10)) < tolerance - TIE
    same = F.lower(actual) == F.lower(expected)
    return pairs.withColumn("matches", F.coalesce(
        F.when(a.isNotNull() & e.isNotNull(), close).otherwise(same), F.lit(False)))


def value_overlap(actual: DataFrame, expected: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Per key: how many distinct text values also occur in the expected set."""
    got = actual.select(key, F.lower(value).alias("_v")).distinct()
    want = expected.select(F.lower(value).alias("_v")).distinct()
    return got.join(want, "_v", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("shared"))


def stratified_sample(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """n rows keeping the strata's ratio: ``max(1, round(n * size / total))``
    first rows of each (half to even), then trimmed or padded to n in order; all
    rows in order if there are no more than n.
    ``order`` is unique.  Strata keep the order of their first row.  At most n
    rows per stratum and n rows overall are looked at after the counts."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("_quota", F.greatest(
        F.lit(1), F.bround(F.lit(n) * F.col("_size") / F.col("_total"), 0).cast("int")))
    head = top_n(rows, [stratum], [F.col(order)], n, "_rn").join(quota, stratum)
    # picked rows come stratum by stratum, padding follows in overall order
    picked = (F.col("_rn") <= F.col("_quota")) & (F.col("_total") > n)
    rank = F.when(picked, F.struct(F.lit(0).alias("a"), F.col("_first").alias("b"), F.col(order).alias("c"))).otherwise(
        F.struct(F.lit(1).alias("a"), F.col(order).alias("b"), F.col(order).alias("c")))
    return head.orderBy(rank).limit(n).drop("_rn", "_size", "_first", "_total", "_quota")

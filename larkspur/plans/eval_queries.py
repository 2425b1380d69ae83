"""Evaluation-run queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evalruns as ev
from ..session import stash
from ..sources import fixtures as fx
from .registry import define, mean, query, rnd, share, sql

_FITS = """(expected_intent = 'structured' AND (list_contains(tools_used, 'query_analyst') OR list_contains(tools_used, 'structured')))
  OR (expected_intent = 'semantic' AND list_contains(tools_used, 'search_reviews'))
  OR (expected_intent = 'synthesis' AND len(tools_used) >= 2)"""
define("prepared", ["runs"], f"""SELECT *, CAST(round(llm_calls * 0.003, 4) AS DECIMAL(10,4)) AS estimated_cost FROM (
  SELECT *, actual_intent = expected_intent OR ((actual_intent = 'agent' OR starts_with(actual_intent, 'structured')) AND ({_FITS})) AS intent_correct,
  CASE WHEN fallback_used THEN CASE WHEN contains(actual_intent, 'structured') THEN 0 WHEN contains(actual_intent, 'semantic') THEN 1 ELSE 2 END
    WHEN actual_intent = 'agent' OR (len(tools_used) > 0 AND tools_used <> ['structured']) THEN CASE WHEN has_reflection THEN 3 ELSE 2 END
    ELSE 1 END AS llm_calls,
  CASE WHEN fallback_used THEN 'legacy_' || actual_intent ELSE 'agent' END AS query_path,
  CASE split_part(question_id, '_', 1) WHEN 'cat' THEN 'category' WHEN 'prod' THEN 'product' WHEN 'theme' THEN 'theme'
    ELSE 'unknown' END AS question_type FROM runs)""")


def _scores(digits: int) -> str:
    return ", ".join(f"{mean('judge_' + n, digits)} AS avg_{n}" for n in ("factuality", "completeness", "citation", "context"))


define("percentiles", ["runs"], """SELECT model, percent, CAST(v[1 + CAST(least(len(v) * percent // 100, len(v) - 1) AS BIGINT)] AS DOUBLE) AS value
  FROM (SELECT model, list(latency_s ORDER BY latency_s) AS v FROM runs GROUP BY model), (SELECT unnest([50, 95, 99]) AS percent)""")
define("run_summary", ["prepared", "percentiles"], f"""SELECT s.*, p50.value AS latency_p50, p95.value AS latency_p95, p99.value AS latency_p99 FROM (
  SELECT run_id, model, count(*) AS evaluated, {share('intent_correct', 4)} AS intent_accuracy,
  {share('data_correct', 4)} AS data_correctness, {_scores(2)},
  count(*) FILTER (WHERE is_hallucination) AS hallucination_count, {share('is_hallucination', 4)} AS hallucination_rate,
  count(*) FILTER (WHERE fallback_used) AS fallback_count, {share('fallback_used', 4)} AS fallback_rate,
  {mean('latency_s', 2)} AS latency_avg, {mean('estimated_cost', 4)} AS avg_cost_per_query,
  {rnd('sum(estimated_cost)', 2)} AS total_eval_cost FROM prepared GROUP BY run_id, model) s
  JOIN percentiles p50 ON s.model = p50.model AND p50.percent = 50 JOIN percentiles p95 ON s.model = p95.model AND p95.percent = 95
  JOIN percentiles p99 ON s.model = p99.model AND p99.percent = 99""")


@query("v2_routing_correct", sql("""SELECT model, expected_intent, actual_intent, intent_correct, count(*) AS n
  FROM prepared GROUP BY ALL""", "prepared"))
def _(spark, d):
    return ev.prepared(fx.eval_runs(spark, d)).groupBy(
        "model", "expected_intent", "actual_intent", "intent_correct").agg(F.count(F.lit(1)).alias("n"))


@query("v3_run_summary", sql("SELECT * FROM run_summary", "run_summary"))
def _(spark, d):
    return ev.run_summary(fx.eval_runs(spark, d))


@query("g17_model_summary", sql(f"""SELECT run_id, model, judge_model, count(*) AS questions,
  {share('intent_correct', 4)} AS intent_accuracy, {share('data_correct', 4)} AS data_correctness, {_scores(4)},
  {share('is_hallucination', 4)} AS hallucination_rate, {share('fallback_used', 4)} AS fallback_rate,
  {mean('latency_s * 1000', 2)} AS avg_latency_ms, CAST(sum(estimated_cost) AS DOUBLE) AS total_cost
  FROM prepared GROUP BY ALL""", "prepared"))
def _(spark, d):
    return ev.model_summary(fx.eval_runs(spark, d))


@query("g18_nearest_rank", sql("SELECT * FROM percentiles", "percentiles"))
def _(spark, d):
    return ev.nearest_rank(fx.eval_runs(spark, d), ["model"], "latency_s", [50, 95, 99])


@query("g19_tool_counts", sql("SELECT tool, count(*) AS uses FROM (SELECT unnest(tools_used) AS tool FROM runs) GROUP BY tool", "runs"))
def _(spark, d):
    return ev.tool_counts(fx.eval_runs(spark, d))


@query("g19_path_counts", sql("SELECT query_path, count(*) AS questions FROM prepared GROUP BY query_path", "prepared"))
def _(spark, d):
    return ev.path_counts(fx.eval_runs(spark, d))


@query("v4_cost_by_path", sql("""SELECT query_path, llm_calls, count(*) AS n, CAST(sum(estimated_cost) AS DOUBLE) AS cost
  FROM prepared GROUP BY ALL""", "prepared"))
def _(spark, d):
    return ev.with_costs(fx.eval_runs(spark, d)).groupBy("query_path", "llm_calls").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_cost").alias("cost"))


_LONG = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, model, CAST({m} AS DOUBLE) AS value, {'TRUE' if up else 'FALSE'} AS up FROM run_summary"
    for m, up in ev.WINNER_METRICS.items())


@query("v5_metric_winners", sql(f"""SELECT metric, model AS winner, value FROM (SELECT *, row_number() OVER (PARTITION BY metric
  ORDER BY CASE WHEN up THEN -value ELSE value END, model) AS rn FROM ({_LONG})) WHERE rn = 1""", "run_summary"))
def _(spark, d):
    return ev.metric_winners(stash(ev.run_summary(fx.eval_runs(spark, d)), "runs"))


MODELS = ["click", "error", "purchase", "signup", "view"]


@query("v6_case_matrix", sql("SELECT question_id, expected_intent, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN cell END) AS {m}" for m in MODELS) + """ FROM (
  SELECT *, 'I' || CASE WHEN intent_correct THEN '+' ELSE '-' END || ' D' || CASE WHEN data_correct THEN '+' ELSE '-' END || ' F'
   || judge_factuality || ' C' || judge_citation || ' ' || array_to_string(tools_used, '/') AS cell,
   row_number() OVER (PARTITION BY question_id, model ORDER BY event_id) AS rn FROM prepared) WHERE rn = 1
  GROUP BY question_id, expected_intent""", "prepared"))
def _(spark, d):
    return ev.case_matrix(fx.eval_runs(spark, d), MODELS)


@query("v7_question_type", sql("SELECT question_type, count(*) AS n FROM prepared GROUP BY question_type", "prepared"))
def _(spark, d):
    return fx.eval_runs(spark, d).groupBy(ev.question_type(F.col("question_id")).alias("question_type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("v8_intent_breakdown", sql(f"""SELECT expected_intent, count(*) AS questions, {share('intent_correct', 4)} AS intent_accuracy,
  {mean('judge_factuality', 2)} AS avg_factuality FROM prepared GROUP BY expected_intent""", "prepared"))
def _(spark, d):
    return ev.intent_breakdown(fx.eval_runs(spark, d))


@query("v1_tolerant_match", sql("""SELECT event_id, actual, expected, CASE
  WHEN TRY_CAST(actual AS DOUBLE) IS NOT NULL AND TRY_CAST(expected AS DOUBLE) IS NOT NULL
    THEN abs(CAST(actual AS DOUBLE) - CAST(expected AS DOUBLE)) / greatest(abs(CAST(expected AS DOUBLE)), 1e-10) < 0.05 - 1e-9
  ELSE lower(actual) = lower(expected) END AS matches FROM (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE CAST(event_id AS VARCHAR) END AS actual,
   CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'view' END
     ELSE CAST(event_id + user_id AS VARCHAR) END AS expected FROM events)"""))
def _(spark, d):
    e = fx.table(spark, d, "events")
    third = F.col("event_id") % 3 == 0
    pairs = e.select("event_id", F.when(third, F.upper("event_type")).otherwise(F.col("event_id").cast("string")).alias("actual"),
                     F.when(third, F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("view"))
                     .otherwise((F.col("event_id") + F.col("user_id")).cast("string")).alias("expected"))
    return ev.tolerant_match(pairs, "actual", "expected")


define("strata", ["prepared"], """SELECT question_type, count(*) AS size, min(event_id) AS first,
  greatest(1, CAST(round_even(30 * count(*)::DOUBLE / (SELECT count(*) FROM prepared), 0) AS INTEGER)) AS quota
  FROM prepared GROUP BY question_type""")


@query("k6_stratified_sample", sql("""SELECT event_id, question_type, model FROM (SELECT p.*, first, quota, row_number() OVER (
  PARTITION BY p.question_type ORDER BY event_id) AS rn FROM prepared p JOIN strata s ON p.question_type = s.question_type)
  ORDER BY CASE WHEN rn <= quota THEN 0 ELSE 1 END, CASE WHEN rn <= quota THEN first ELSE event_id END, event_id LIMIT 30""",
                              "prepared", "strata"))
def _(spark, d):
    r = ev.prepared(fx.eval_runs(spark, d)).select("event_id", "question_type", "model")
    return ev.stratified_sample(r, "question_type", "event_id", 30)


@query("a9_eval_rows", sql("""SELECT event_id, model AS actual_intent, array_to_string(tools_used, ',') AS tools_used
  FROM runs WHERE model <> 'error'""", "runs"))
def _(spark, d):
    from ..sources.sinks import shape_eval_rows
    raw = fx.eval_runs(spark, d).select(
        "event_id", F.col("model").alias("actual_intent"), F.to_json("tools_used").alias("tools_used"),
        F.when(F.col("model") == "error", "timeout").alias("api_error"))
    return shape_eval_rows(raw)

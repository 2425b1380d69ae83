"""End-to-end jobs: batch build, streams, landing files, plan shapes."""

import json

import pytest
from larkspur.operators import marts, monitor, quality
from larkspur.plans import metrics, warehouse
from larkspur.sources import fixtures as fx
from larkspur.sources import landing, runs, sinks
from larkspur.streaming import common, jobs
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ----------------------------------------------------------------- batch build

@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    months = F.expr("add_months(date'2020-01-01', cast(id % 8 as int))")
    words = F.element_at(F.array(*[F.lit(x) for x in (
        "great battery and charger, love it", "broken sound, bad bass and audio", "good price and value for money",
        "the bluetooth connection is terrible")]), (F.col("id") % 4 + 1).cast("int"))
    raw = spark.range(1200).select(
        F.to_json(F.struct(
            F.concat(F.lit("r"), (F.col("id") % 1100).cast("string")).alias("review_id"),
            F.concat(F.lit("B0"), (F.col("id") % 5).cast("string")).alias("asin"), F.lit("u").alias("user_id"),
            (1 + F.col("id") % 5).alias("rating"), F.lit("Acme - Speaker").alias("title"),
            F.concat(words, F.repeat(F.lit(" speaker review. More words here."), (F.col("id") % 30).cast("int"))).alias("review_text"),
            months.cast("string").alias("review_ts"))).alias("v"), F.lit("Electronics").alias("source_category"))
    meta = spark.createDataFrame([("B01", "Meta Speaker", "Acme", 20.0, "a|b", "Audio", ["B02"])],
                                 "asin string, title string, brand string, price double, features_text string, category_path string, also_buy array<string>")
    out = str(tmp_path_factory.mktemp("warehouse"))
    return raw, meta, out, warehouse.build(raw, meta, out, "2020-08-20")


def test_build_tables_pass_their_expectations(built):
    _, _, _, t = built
    assert t["enriched_reviews"].count() == t["fact_reviews"].count() == 1100
    checks = quality.expectations(
        t["fact_reviews"], "fact_reviews", not_null=["review_id", "sentiment_score", "review_theme", "review_summary", "derived_category"],
        accepted={"rating": [1, 2, 3, 4, 5], "review_quality": ["high", "medium", "low"], "derived_category": ["speakers"]},
        unique=["review_id"], relationships={"asin": (t["product_lookup"], "asin")})
    assert checks.where("failures > 0").count() == 0
    names = {r.asin: (r.product_name, r.has_metadata) for r in t["product_lookup"].collect()}
    assert names["B01"] == ("Meta Speaker", True) and names["B02"] == ("Speaker", False)
    assert t["data_quality_checks"].where("status <> 'PASS'").count() == 0


def test_second_build_leaves_enriched_rows_alone(spark, built, tmp_path):
    raw, meta, _, t = built
    marked = t["enriched_reviews"].withColumn("review_summary", F.lit("kept"))
    again = warehouse.build(raw, meta, str(tmp_path), "2020-09-01", previous=marked)
    assert again["enriched_reviews"].where("review_summary <> 'kept'").count() == 0


def test_metric_names_are_checked(built):
    marts = warehouse.build_marts(built[3]["fact_reviews"])
    with pytest.raises(KeyError):
        metrics.metric_query(marts, "complaints", ["price"])
    assert metrics.metric_query(marts, "category_sentiment", ["total reviews"]).first()[0] == 1100


def _rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def _reviews(spark, ids, products):
    return spark.createDataFrame([(i,) for i in ids], "id int").select(
        F.to_json(F.struct(
            F.concat(F.lit("r"), "id").alias("review_id"), F.concat(F.lit("B0"), F.col("id") % products).alias("asin"),
            F.lit("u").alias("user_id"), (1 + F.col("id") % 5).alias("rating"), F.lit("Acme - Speaker").alias("title"),
            F.concat(F.lit("great battery and speaker number "), "id", F.repeat(F.lit(" more words"), F.col("id") % 7)).alias("review_text"),
            F.concat(F.lit("2020-0"), 1 + F.col("id") % 6, F.lit("-03")).alias("review_ts"))).alias("v"),
        F.lit("Electronics").alias("source_category"), F.lit("a.json").alias("source_file"),
        F.lit("2020-07-01 00:00:00").cast("timestamp_ntz").alias("loaded_at"))


MARTS = ["category_summary", "monthly_trends", "product_summary", "theme_category", "complaint_analysis"]


def test_runs_add_up_to_a_rebuild_even_after_a_crash(spark, built, tmp_path, monkeypatch):
    """Three runs into one folder, the second one dying half-way, against one build of
    everything.  Some products reach the three reviews of a category only later."""
    meta, out = built[1], str(tmp_path / "grown")
    one, two = list(range(0, 120)), list(range(0, 260))
    warehouse.build(_reviews(spark, one, 90), meta, out, "2020-07-10")
    first = {r.asin: r.review_count for r in runs.read(spark, f"{out}/product_categories").collect()}
    assert first == {}
    crash = monkeypatch.context()
    with crash as m:
        m.setattr(warehouse.marts, "fact_reviews", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            warehouse.build(_reviews(spark, two, 90), meta, out, "2020-07-11")
    t = warehouse.build(_reviews(spark, two, 90), meta, out, "2020-07-11")
    want = warehouse.build(_reviews(spark, two, 90), meta, str(tmp_path / "fresh"), "2020-07-11")
    for name in ["enriched_reviews", "product_categories", "fact_reviews", "ingestion_health", *MARTS]:
        assert _rows(t[name]) == _rows(want[name]), name
    assert t["theme_category"].count() > 0 and t["enriched_reviews"].count() == 260
    ids = [r.alert_id for r in t["alert_log"].collect()]
    assert len(ids) == len(set(ids))
    # a category that exists keeps its first review count until a full refresh
    more = _reviews(spark, [*two, *range(270, 360)], 90)
    kept = _rows(warehouse.build(more, meta, out, "2020-07-13")["product_categories"])
    assert set(_rows(want["product_categories"])) < set(kept) and len(kept) == 90
    fresh = warehouse.build(more, meta, out, "2020-07-13", full_refresh=True)
    assert {r.review_count for r in fresh["product_categories"].collect()} == {3, 4}
    assert sum(r.review_count for r in fresh["category_summary"].collect()) == 350


def test_marts_do_not_read_the_fact_table_again(spark, tmp_path):
    out = str(tmp_path)
    fact = fx.reviews(spark, "/root/testdata/sf0.001")
    state = marts.group_state(fact, *marts.STATES["theme"])
    half = [marts.group_state(fact.where(F.col("supplier") % 2 == i), *marts.STATES["theme"]) for i in (0, 1)]
    for s in half:
        runs.append(s, f"{out}/theme")
    merged = marts.merge_states(runs.read(spark, f"{out}/theme"), *marts.STATES["theme"])
    assert _rows(marts.themes_from_state(merged)) == _rows(marts.themes_from_state(state))
    assert _rows(marts.complaints_from_state(merged)) == _rows(marts.complaint_analysis(fact))
    assert "lineitem" not in plan(marts.themes_from_state(merged))


# ------------------------------------------------------------------------ runs

def test_run_tables(spark, tmp_path):
    table = str(tmp_path / "t")
    assert runs.read(spark, table) is None
    assert runs.append(spark.range(3), table).count() == 3
    runs.append(spark.range(3, 5), table)
    assert sorted(r.id for r in runs.read(spark, table).collect()) == [0, 1, 2, 3, 4]
    # a rebuild may read what it replaces, and a run that fails changes nothing
    runs.replace(runs.read(spark, table).where("id % 2 = 0"), table)
    with pytest.raises(Exception):
        runs.append(spark.range(2).select(F.raise_error(F.lit("lost")).alias("id")), table)
    assert sorted(r.id for r in runs.read(spark, table).collect()) == [0, 2, 4]
    with pytest.raises(runs.Conflict):
        runs._commit(spark, table, [], 1)
    assert len(runs.sweep(spark, table, keep=1)) == 3
    assert sorted(r.id for r in runs.read(spark, table).collect()) == [0, 2, 4]
    grown = runs.grow(spark.range(6), table, "id", lambda d: d)
    assert sorted(r.id for r in grown.collect()) == [0, 1, 2, 3, 4, 5] and len(runs.folders(spark, table)) == 2


def test_materialise_refuses_to_overwrite_its_input(spark, tmp_path):
    path = str(tmp_path / "t")
    df = sinks.materialise(spark.range(3), path)
    with pytest.raises(ValueError):
        sinks.materialise(df.where("id > 0"), path)
    assert sinks.materialise(df, str(tmp_path / "t2")).count() == 3


# --------------------------------------------------------------------- landing

def test_json_lines_skip_broken_lines_and_read_both_spellings(spark, tmp_path):
    lines = [json.dumps({"review_id": "1", "text": "a text that is long enough", "timestamp": 1600000000, "rating": "4"}),
             json.dumps({"review_id": "2", "review_text": "another text that is long", "review_ts": "2020-01-01 00:00:00", "rating": 9}),
             json.dumps({"review_id": "3", "review_text": "too short", "review_ts": "2020-01-01", "rating": 3}), "{broken"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    raw = landing.read_json_lines(spark, str(tmp_path), "Cat")
    assert raw.count() == 3 and raw.first()["source_file"].endswith("in.json")
    assert [r.review_id for r in landing.stage_reviews(raw).collect()] == ["1"]
    p = landing.input_profile(spark.read.text(str(tmp_path))).first()
    assert (p.valid_lines, p.invalid_lines) == (3, 1)


AWKWARD = ['{"asin":"a","n":1.5,"deep":{"x":null,"y":[1,"z",{"q":true}]},"none":null,"imageURL":["u"]}', "[1, 2]", "7",
           '"text"', "null", "", "   ", "{broken", '{"asin":"a","asin":"b"}', "{}", '  {"asin":"é","big":12345678901234567890123}']


def test_metadata_is_rewritten_in_one_pass(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(AWKWARD))
    out = str(tmp_path / "out")
    assert tuple(landing.prepare_metadata(spark, str(tmp_path / "in.json"), out).first()) == (3, 8)
    got = [json.loads(r.value) for r in spark.read.text(out).collect()]
    want = [json.loads(AWKWARD[i]) for i in (0, 9, 10)]
    want[0].pop("imageURL")
    assert sorted(got, key=str) == sorted(want, key=str)
    parsed = landing.parsed_lines(spark.read.text(str(tmp_path / "in.json"))).where("v is not null")
    assert plan(parsed).count("try_parse_json") + plan(parsed).count("parse_json") <= 2  # once, shown twice by Generate
    p = landing.input_profile(spark.read.text(str(tmp_path / "in.json"))).first()
    assert (p.valid_lines, p.invalid_lines) == (3, 8)


def test_ingest_appends_counted_rows(spark, tmp_path):
    (tmp_path / "in.json").write_text("\n".join(AWKWARD))
    target = str(tmp_path / "landing")
    for category in ("A", "B"):
        assert landing.ingest_category(spark, str(tmp_path / "in.json"), category, target) == {"rows": 3, "skipped": 8}
    raw = runs.read(spark, target)
    assert raw.count() == 6 and dict(raw.dtypes)["v"] == "variant"
    health = {r.source_category: r.unique_asins for r in landing.ingestion_health(raw).collect()}
    assert health == {"A": 2, "B": 2}
    assert {r.asin for r in landing.raw_keys(raw).collect()} == {"a", "é", None}


# --------------------------------------------------------------------- streams

def test_ingest_is_first_arrival_and_replay_safe(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "review_id string, v int"

    def feed(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.ingest_reviews(spark, src, schema, out, check, [F.col("v")])

    feed([("a", 2), ("a", 1), ("b", 1)])
    feed([("a", 0), ("c", 3)])
    jobs.ingest_reviews(spark, src, schema, out, check, [F.col("v")])  # nothing new
    want = [("a", 1), ("b", 1), ("c", 3)]
    assert sorted((r.review_id, r.v) for r in spark.read.parquet(out).collect()) == want
    # a lost checkpoint replays every file as one batch: same table
    jobs.ingest_reviews(spark, src, schema, str(tmp_path / "out2"), str(tmp_path / "check2"), [F.col("v")])
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3


def test_key_ledger_is_pruned_to_the_batch(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("review_id"))
    common.write_batch(rows, target, 0, "review_id")
    batch = spark.createDataFrame([("r5",), ("r5",), ("new",), (None,)], "review_id string")
    known = common.known_keys(batch, target, 1, "review_id")
    assert 0 < known.count() < 100 and "bucket" in plan(known).split("PartitionFilters")[1][:200]
    assert sorted(r.review_id or "" for r in common.unseen(batch, target, 1, "review_id").collect()) == ["", "new"]
    # the batch's own earlier attempt does not count as known
    assert common.unseen(batch, target, 0, "review_id").count() == 4
    old = str(tmp_path / "old")
    common.write_batch(rows, old, 0)
    assert sorted(r.review_id or "" for r in common.unseen(batch, old, 1, "review_id").collect()) == ["", "new"]
    assert common.unseen(batch, str(tmp_path / "none"), 0, "review_id").count() == 4


def test_alert_stream_logs_once(spark, tmp_path):
    src, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    ddl = ", ".join(f"{n} {k}" for n, k in monitor.ANOMALY_COLUMNS.items())
    row = ("RATING_DROP", "c", None, None, 1.0, 2.0, 3.0, 4, 0.1, 0.2, "HIGH")
    for value in (row, row, row[:4] + (9.0,) + row[5:]):
        spark.createDataFrame([value], ddl).write.mode("append").parquet(src)
        jobs.log_anomalies(spark, src, ddl, log, check)
    assert spark.read.parquet(log).count() == 2


# ----------------------------------------------------------------- plan shapes

def test_scan_reads_only_needed_columns(spark, sf):
    df = fx.reviews(spark, sf).groupBy("rating").count()
    scans = [line for line in plan(df).splitlines() if "FileScan" in line and "lineitem" in line]
    assert scans and all("l_tax" not in s and "l_linestatus" not in s for s in scans)


def test_filter_is_pushed_to_the_scan(spark, sf):
    df = fx.table(spark, sf, "lineitem").where("l_shipdate > timestamp_ntz'2000-01-01 00:00:00'").select("l_orderkey")
    assert "GreaterThan(l_shipdate" in plan(df)


def test_no_python_and_no_cartesian_in_the_marts(spark, sf):
    fact = fx.reviews(spark, sf)
    for df in warehouse.build_marts(fact).values():
        p = plan(df)
        assert "CartesianProduct" not in p and "Python" not in p and "NestedLoop" not in p


def test_summary_needs_one_scan_and_no_python(spark, sf):
    from larkspur.operators.enrich import with_summary
    p = plan(with_summary(fx.documents(spark, sf), "review_text"))
    assert "ArrowEvalPython" not in p and p.count("FileScan") == 1

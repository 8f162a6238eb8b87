from __future__ import annotations

from conftest import records
from pyspark.sql import functions as F

from footfall.functions import scalars, times
from footfall.operators import clean, features
from footfall.operators import outcomes as oc
from footfall.plans.journeys import clean_and_label
from footfall.sources import tables

DAY = 86_400


def test_dedup_keeps_the_first_row(log):
    df = log([("a", "x", 0), ("a", "x", 0), ("a", "y", 0), ("b", "x", 0)])
    kept = records(clean.dedup_events(df), "event_id")
    assert [r["event_id"] for r in kept] == [0, 2, 3]


def test_dedup_keeps_whole_rows(log):
    df = log([("a", "x", 0), ("a", "x", 0)]).withColumn("extra", F.col("event_id") * 10)
    assert records(clean.dedup_events(df))[0]["extra"] == 0


def test_one_key_holding_most_rows(log):
    rows = [("hot", "x", 5)] * 3000 + [("a", "x", i) for i in range(50)]
    df = log(rows).repartition(8)
    profile = clean.duplicate_profile(df).first()
    assert (profile["n_rows"], profile["n_duplicates"]) == (3050, 2999)
    assert clean.dedup_events(df).count() == 51
    assert clean.duplicate_groups(df).count() == 3000


def test_outcome_at_the_inactivity_limit(log):
    df = log([("late", "x", 100 * DAY), ("limit", "x", 40 * DAY), ("inside", "x", 40 * DAY + 1), ("won", "order_shipped", 0)])
    elapsed = {r["id"]: r["final_outcome"] for r in records(oc.label_outcomes(oc.journey_status(df)))}
    assert elapsed == {"late": "incomplete", "limit": "failure", "inside": "incomplete", "won": "success"}
    strict = {r["id"]: r["final_outcome"] for r in records(oc.label_outcomes(oc.journey_status(df), rule="dates"))}
    assert strict["limit"] == "incomplete"
    window = {r["id"]: r["final_outcome"] for r in records(oc.label_outcomes(oc.journey_status(df), rule="window"))}
    assert window["limit"] == "incomplete"
    opened = {r["id"]: r["incomplete"] for r in records(oc.is_open(oc.journey_status(df)))}
    assert opened == {"late": True, "limit": True, "inside": True, "won": False}


def test_events_before_the_first_target(log):
    df = log([("a", "x", 0), ("a", "order_shipped", 5), ("a", "y", 9), ("b", "x", 1), ("c", "order_shipped", 0), ("c", "x", 1)])
    assert [r["event_id"] for r in records(oc.visible_before_first(df), "event_id")] == [0, 3]


def test_clean_and_label_agree_with_the_clean_log(log):
    df = log([("a", "x", 0), ("a", "x", 0), ("a", "order_shipped", 5), ("b", "x", 90 * DAY)])
    events, outcomes = clean_and_label(df)
    again = oc.label_outcomes(oc.journey_status(events))
    assert records(outcomes, "id") == records(again, "id")
    assert events.count() == 3


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert {r["column_name"]: (r["n_null"], r["pct_null"]) for r in clean.null_profile(df).collect()} == {
        "a": (1, 33.33),
        "b": (2, 66.67),
    }


def test_event_csv_with_bad_times(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text(
        "customer_id,account_id,id,ed_id,event_name,event_timestamp,journey_steps_until_end,sep\n"
        "1,2,1 2,4,browse_products,2021-02-03T04:05:06Z,3,\n"
        "1,2,1 2,5,view_cart,yesterday,2,\n"
    )
    df = tables.read_events_csv(spark, str(path), ["id", "event_name", "event_timestamp"])
    rows = df.select("event_name", times.micros("event_timestamp").alias("us")).orderBy("event_name").collect()
    assert [r["us"] for r in rows] == [1_612_325_106_000_000, None]


def test_event_definitions_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "definitions.csv"
    text = "event_name,journey_id,event_definition_id,milestone_number,stage\nadd_to_cart,1,11,,First Purchase\norder_shipped,1,28,6,Order Shipped\n"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    rows = records(tables.read_event_definitions(spark, str(path)), "event_definition_id")
    assert [(r["event_name"], r["milestone_number"], r["stage"]) for r in rows] == [
        ("add_to_cart", None, "First Purchase"),
        ("order_shipped", 6, "Order Shipped"),
    ]


def test_load_or_build_checks_coverage(spark, tmp_path):
    path = str(tmp_path / "daily")
    calls = []

    def build(n):
        def run():
            calls.append(n)
            return spark.range(n).select(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")).alias("ds"))

        return run

    tables.load_or_build(spark, path, build(3), ("ds", "2024-01-03"))
    assert tables.load_or_build(spark, path, build(9), ("ds", "2024-01-03")).count() == 3
    assert tables.load_or_build(spark, path, build(9), ("ds", "2024-01-05")).count() == 9
    assert calls == [3, 9]


def test_coverage_is_compared_by_value(spark, tmp_path):
    path = str(tmp_path / "numbers")
    tables.load_or_build(spark, path, lambda: spark.range(10))
    assert tables.load_or_build(spark, path, lambda: spark.range(60), ("id", 9)).count() == 10
    assert tables.load_or_build(spark, path, lambda: spark.range(60), ("id", 50)).count() == 60


def test_repeated_rows_with_null_keys(spark):
    rows = [("a", None, 1), ("a", None, 2), ("b", "x", 3), (None, "x", 4), (None, "x", 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "k string, name string, n int")
    assert sorted(r.n for r in clean.duplicate_groups(df, ["k", "name"]).collect()) == [1, 2, 4, 5]


def test_repeated_template_id_is_refused(spark, tmp_path):
    path = tmp_path / "template.csv"
    path.write_text("id,order_shipped\na b,0\nc d,0\na b,0\n")
    try:
        tables.load_template(spark, str(path))
    except ValueError as e:
        assert "more than once" in str(e)
    else:
        raise AssertionError("a repeated id was accepted")


def test_template_rows_are_checked(spark, tmp_path):
    path = tmp_path / "template.csv"
    path.write_text("id,order_shipped\na b,0\nc d,0\n")
    assert [r["id"] for r in tables.load_template(spark, str(path), 2).orderBy("position").collect()] == ["a b", "c d"]
    try:
        tables.load_template(spark, str(path), 3)
    except ValueError as e:
        assert "expected 3" in str(e)
    else:
        raise AssertionError("a short template was accepted")


def test_prediction_csv(spark, tmp_path):
    df = spark.createDataFrame([("a 1", 0.25), ("b 2", 0.5)], "id string, p double")
    tables.write_predictions(df, str(tmp_path / "out"))
    assert records(tables.read_predictions(spark, str(tmp_path / "out")), "id") == [
        {"id": "a 1", "order_shipped": 0.25},
        {"id": "b 2", "order_shipped": 0.5},
    ]


def test_aligned_and_numeric_columns(spark):
    df = spark.createDataFrame([("1", "x", 2.0)], "a string, b string, c double")
    out = features.align_columns(features.to_numeric(df, ["a", "b"]), ["b", "a", "z"])
    assert out.columns == ["b", "a", "z"]
    assert tuple(out.first()) == (0.0, 1.0, 0)


def test_leap_day_and_week_blocks(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-01-06",), ("2023-01-07",)], "d string").select(F.to_date("d").alias("d"))
    rows = df.select(times.align_to_year("d", 2023).cast("string").alias("a"), times.year_week_start("d").cast("string").alias("w"))
    assert [tuple(r) for r in rows.collect()] == [
        ("2023-02-28", "2024-02-26"),
        ("2023-01-06", "2023-01-01"),
        ("2023-01-07", "2023-01-08"),
    ]


def test_clip_and_suffix(spark):
    row = spark.range(1).select(
        scalars.clip(F.lit(1.7), 0.0, 1.0).alias("hi"),
        scalars.clip(F.lit(-1.0), 0.0).alias("lo"),
        scalars.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("none"),
        scalars.strip_suffix(F.lit("7 12_3")).alias("id"),
        scalars.plain_name(F.lit("catalog_(mail)")).alias("name"),
    ).first()
    assert tuple(row) == (1.0, 0.0, None, "7 12", "catalog_mail")


def test_partitioned_table_has_files_by_size(spark, tmp_path):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 999, "mild").alias("v"), "id").repartition(8)
    tables.write_table(df, str(tmp_path / "t"), "v", rows_per_file=300)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["id"] for r in back.collect()) == list(range(1000))
    assert len(list((tmp_path / "t" / "v=mild").glob("*.parquet"))) == 1
    assert len(list((tmp_path / "t" / "v=hot").glob("*.parquet"))) <= 3


def test_scratch_is_cleared(spark):
    from footfall import clear_scratch, materialize

    kept = materialize(spark.range(3), "kept")
    assert kept.count() == 3
    path = kept.inputFiles()[0]
    clear_scratch(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))

"""Quantiles, samples, metrics and series against plain Python and numpy."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from footfall.operators import forecast, metrics, sampling, series
from footfall.operators.quantiles import distribution, histogram, quantiles, value_ranks


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    xs = [0.0] * 400 + [rng.expovariate(0.001) for _ in range(500)] + [-rng.random() for _ in range(100)]
    rng.shuffle(xs)
    rows = [(i, x, "ab"[i % 2]) for i, x in enumerate(xs)]
    return rows, spark.createDataFrame(rows, "k long, x double, g string").repartition(6)


def test_distribution(values):
    rows, df = values
    probs = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p99": 0.99}
    for r in records(distribution(df, "x", probs, ["g"]), "g"):
        xs = np.array([x for _, x, g in rows if g == r["g"]])
        assert r["n"] == len(xs) and r["min"] == xs.min() and r["max"] == xs.max()
        assert r["mean"] == pytest.approx(xs.mean()) and r["sd"] == pytest.approx(xs.std(ddof=1))
        for name, q in probs.items():
            assert r[name] == pytest.approx(np.quantile(xs, q))


def test_column_named_like_a_result(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "n int")
    assert quantiles(df, "n", {"min": 0.5}).first().asDict() == {"min": 2.0}


def test_nearest_rank(values):
    rows, df = values
    xs = sorted(x for _, x, _ in rows)
    got = quantiles(df, "x", {"p80": 0.8}, method="nearest").first()["p80"]
    assert got == xs[int(0.8 * (len(xs) - 1) + 0.5)]


def test_ranks_of_ties(values):
    rows, df = values
    xs = [x for _, x, _ in rows]
    for r in value_ranks(df, "x").collect():
        assert r["below"] == sum(v < r["x"] for v in xs) and r["n"] == xs.count(r["x"])


def test_histogram_keeps_every_row(values):
    _, df = values
    bins = records(histogram(df, "x", 7), "bin")
    assert len(bins) == 7 and sum(b["n"] for b in bins) == 1000


def test_exact_sample_sizes(values):
    _, df = values
    quota = df.sparkSession.createDataFrame([("a", 37), ("b", 9999)], "g string, n_take long")
    taken = sampling.take_quota(df, quota, "g", "k")
    assert {r["g"]: r["count"] for r in taken.groupBy("g").count().collect()} == {"a": 37, "b": 500}
    again = sampling.take_quota(df.repartition(3), quota, "g", "k")
    assert {r["k"] for r in taken.collect()} == {r["k"] for r in again.collect()}


def test_a_class_with_no_quota_is_left_out(values):
    _, df = values
    quota = df.sparkSession.createDataFrame([("a", 0), ("b", 5)], "g string, n_take long")
    assert sampling.take_quota(df, quota, "g", "k").groupBy("g").count().collect()[0].asDict() == {"g": "b", "count": 5}


def test_folds_are_even_and_do_not_overlap(values):
    _, df = values
    rows = df.withColumn("id", (F.col("k") / 5).cast("int").cast("string")).withColumn("label", (F.col("id").cast("int") % 4 == 0).cast("int"))
    folded = sampling.with_folds(rows, "label")
    assert folded.count() == 1000
    assert sampling.fold_overlap(folded).first()[0] == 0
    sizes = folded.select("id", "label", "fold").distinct().groupBy("label", "fold").count().collect()
    assert {(r["label"], r["count"]) for r in sizes} == {(0, 30), (1, 10)}


def test_holdout_is_stratified(values):
    _, df = values
    split = sampling.stratified_split(df, "g", 0.25, "k")
    assert {(r["g"], r["count"]) for r in split.where("is_valid").groupBy("g").count().collect()} == {("a", 125), ("b", 125)}


def scores(spark, pairs):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(pairs)], "id long, label int, p double")


def test_metrics_by_hand(spark):
    df = scores(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.2), (1, 0.1)])
    r = metrics.evaluate(df).first()
    assert r["roc_auc"] == pytest.approx((3 + 1.5 + 0) / 9)
    assert r["average_precision"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 4 + 1 / 3 * 3 / 6)
    assert r["accuracy"] == pytest.approx(3 / 6)
    assert r["brier"] == pytest.approx(metrics.brier(df).first()[0])
    assert metrics.roc_auc(df).first()[0] == pytest.approx(r["roc_auc"])
    assert metrics.sensitivity_specificity(df).first().asDict() == {
        "sensitivity": pytest.approx(2 / 3),
        "specificity": pytest.approx(1 / 3),
    }


def test_equal_scores(spark):
    df = scores(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)])
    r = metrics.evaluate(df).first()
    assert r["average_precision"] == pytest.approx(0.25) and r["roc_auc"] == pytest.approx(0.5)


def test_report_averages(spark):
    df = scores(spark, [(1, 0.9), (1, 0.1), (0, 0.1), (0, 0.2)])
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rows["1"]["precision"] == 1.0 and rows["1"]["recall"] == 0.5
    assert rows["macro"]["recall"] == pytest.approx(0.75) and rows["weighted"]["support"] == 4


def test_calendar_without_gaps(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 3), (date(2024, 4, 1), 5)], "ds date, y long")
    assert [r["y"] for r in records(series.fill_calendar(df), "ds")] == [3, 0, 0, 5]


def test_future_frame_ends_where_asked(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), 3)], "ds date, y long")
    assert series.future_frame(df, "2024-03-01", "month").count() == 3
    assert series.future_frame(df, "2023-03-01", "month").count() == 1


@pytest.fixture(scope="module")
def months(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(36):
        d = date(2020 + i // 12, i % 12 + 1, 1)
        a = 2 * np.pi * (d.month - 1) / 12
        rows.append((d, int(rng.poisson(np.exp(6 - 0.02 * i + 0.3 * np.cos(a) - 0.2 * np.sin(2 * a))))))
    return rows, spark.createDataFrame(rows, "ds date, y long")


def test_poisson_fit_matches_newton_steps(spark, months):
    rows, df = months
    fit = forecast.fit_poisson(df)
    i = np.arange(36)
    a = 2 * np.pi * (i % 12) / 12
    x = np.column_stack([np.ones(36), i, np.sin(a), np.cos(a), np.sin(2 * a), np.cos(2 * a)])
    y = np.array([r[1] for r in rows], dtype=float)
    beta = np.zeros(6)
    beta[0] = np.log(y.mean())
    for _ in range(50):
        mu = np.exp(x @ beta)
        beta += np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
    mu = np.exp(x @ beta)
    bread = np.linalg.inv(x.T @ (x * mu[:, None]))
    cov = bread @ (x.T @ (x * ((y - mu) ** 2)[:, None])) @ bread
    assert fit.beta == pytest.approx(beta, rel=1e-5, abs=1e-7)
    assert fit.cov == pytest.approx(cov, rel=1e-3, abs=1e-9)
    table = {r["term"]: r for r in fit.table(spark).collect()}
    assert table["trend_month"]["estimate"] == pytest.approx(-0.02, abs=0.01)


def test_poisson_intervals(spark, months):
    _, df = months
    fit = forecast.fit_poisson(df)
    ahead = series.future_frame(df, "2023-12-01", "month", history=False)
    predicted = records(forecast.forecast_poisson(fit, ahead), "ds")
    assert len(predicted) == 12
    assert all(0 <= r["ci_lower"] <= r["predicted_mean"] <= r["ci_upper"] for r in predicted)
    total = forecast.annual_interval(fit, ahead, 4000).first()
    assert total["ci_lower"] < total["predicted_mean"] < total["ci_upper"]
    assert total["predicted_mean"] == pytest.approx(sum(r["predicted_mean"] for r in predicted))


def test_additive_components_add_up(spark):
    start = date(2021, 1, 1)
    rows = [(start + timedelta(days=i), 100 + i // 10 + (20 if (start + timedelta(days=i)).weekday() == 0 else 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "ds date, y long")
    days = forecast.fixed_date_holidays(df.select("ds"), {"new year": (1, 1)})
    fit = forecast.fit_additive(df, yearly=2, changepoints=3, holidays=days)
    out = records(forecast.forecast_additive(fit, series.future_frame(df, "2022-08-01"), days), "ds")
    for r in out:
        assert r["yhat"] == pytest.approx(r["trend"] + r["weekly"] + r["yearly"] + r["holidays"])
        assert r["yhat_lower"] < r["yhat"] < r["yhat_upper"]
    assert np.mean([abs(r["yhat"] - y) for r, (_, y) in zip(out, rows)]) < 3
    assert len(out) > 500
    clipped = forecast.forecast_additive(fit, df.select("ds"), days, floor=0.0, cap=50.0)
    assert clipped.agg(F.max("yhat")).first()[0] == 50.0
    features = forecast.calendar_features(forecast.forecast_additive(fit, df.select("ds"), days).drop("holidays"))
    assert features.agg(F.max("orders_holidays")).first()[0] == 0.0


def test_deviation_of_close_values(spark):
    from footfall.operators.quantiles import distribution

    for base in (0, 10**9, 17 * 10**14):
        got = distribution(spark.range(1000).select((F.col("id") + base).cast("double").alias("v")), "v").first()
        assert got["sd"] == pytest.approx(288.8194, rel=1e-4)


def test_infinite_values_have_quantiles(spark):
    from footfall.operators.quantiles import quantiles

    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (3.0,)], "v double")
    assert tuple(quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).first()) == (1.0, 2.0, 3.0)


def test_ranges_are_even_and_grow_in_number(spark, monkeypatch):
    from footfall.operators import quantiles as qn
    from footfall.operators import spread

    monkeypatch.setattr(spread, "PART_ROWS", 4_000)
    df = spark.range(200_000).select((0.02 + F.col("id") * 5e-9).alias("v")).repartition(5)
    ranged, parts = qn.in_range_parts(df, ["v"])
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
    rows = sorted(sizes.collect())
    assert parts == 50 and len(rows) == 50 and max(r["n"] for r in rows) < 2 * 4_000
    assert all(a["z"] < b["a"] for a, b in zip(rows, rows[1:]))


def test_many_ranges_rank_like_one(spark, monkeypatch):
    from footfall.operators import quantiles as qn
    from footfall.operators import spread

    rows = [(k % 3 or None, float(k * k % 97), k) for k in range(900)] + [(1, float("inf"), 0), (2, float("-inf"), 0)]
    df = spark.createDataFrame(rows, "g int, v double, k int")
    one = {tuple(r) for r in qn.value_ranks(df, "v", ["g"]).collect()}
    monkeypatch.setattr(spread, "PART_ROWS", 20)
    assert {tuple(r) for r in qn.value_ranks(df, "v", ["g"]).collect()} == one and len(one) > 100
    assert tuple(qn.quantiles(df.where("v < 200"), "v", {"m": 0.5}).first()) == (sorted(r[1] for r in rows if r[1] < 200)[450],)


def test_measures_of_one_class(spark):
    from footfall.operators import metrics

    df = spark.createDataFrame([(0, 0.1), (0, 0.7)], "label int, p double")
    row = metrics.evaluate(df).first()
    assert row["average_precision"] is None and row["roc_auc"] is None and row["accuracy"] == 0.5
    assert metrics.roc_auc(df).first()[0] is None and metrics.average_precision(df).first()[0] is None


def test_null_is_a_class_of_its_own(spark):
    from footfall.operators import sampling

    df = spark.createDataFrame([(f"i{k}", None if k % 3 else "a") for k in range(30)], "id string, c string")
    counts = {r["c"]: r["count"] for r in sampling.balance_classes(df, "c", 12).groupBy("c").count().collect()}
    assert counts == {"a": 6, None: 6}
    valid = sampling.stratified_split(df, "c", 0.5).where("is_valid").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in valid} == {"a": 5, None: 10}


def test_weekday_holidays(spark):
    from footfall.operators.forecast import weekday_holidays

    dates = spark.sql("SELECT explode(sequence(DATE '2021-01-01', DATE '2023-12-31')) AS ds")
    got = weekday_holidays(dates, {"thanksgiving": (11, 5, 4), "labor day": (9, 2, 1), "memorial day": (5, 2, -1)})
    assert {(r["holiday"], r["ds"].isoformat()) for r in got.collect()} == {
        ("thanksgiving", "2021-11-25"), ("thanksgiving", "2022-11-24"), ("thanksgiving", "2023-11-23"),
        ("labor day", "2021-09-06"), ("labor day", "2022-09-05"), ("labor day", "2023-09-04"),
        ("memorial day", "2021-05-31"), ("memorial day", "2022-05-30"), ("memorial day", "2023-05-29"),
    }

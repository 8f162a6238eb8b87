"""Sparse, simulated and saturating trends; bagged trees; tables and logs that grow."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import bagging, forecast, growth, series, spread, timeline
from footfall.session import scratch_path
from footfall.sources import incremental
from footfall.streaming import journeys as stream_journeys
from footfall.streaming.monthly import stream_events

FIRST = date(2020, 1, 1)


def daily(spark, values):
    rows = [(FIRST + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ds date, y double")


def test_second_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double").repartition(3)
    assert np.allclose(growth.second_moments(df, ["a", "b", "c", "d"]), x.T @ x)
    assert not growth.second_moments(df.where("a > 100"), ["a", "b"]).any()


def test_lasso_meets_its_conditions():
    rng = np.random.default_rng(1)
    for k, strength in [(5, 0.3), (30, 0.05), (30, 1e-4), (30, 10.0)]:
        x = np.cumsum(np.cumsum(rng.standard_normal((80, k)), axis=1), axis=1)
        y = rng.standard_normal(80) * 3
        gram, cross = x.T @ x / 80, x.T @ y / 80
        penalties = strength * np.sqrt(np.diag(gram))
        b = growth.lasso(gram, cross, penalties, np.zeros(k))
        slope = cross - gram @ b
        assert (np.abs(slope) <= penalties * (1 + 1e-6) + 1e-9).all()
        on = b != 0
        assert np.allclose(slope[on], penalties[on] * np.sign(b[on]), rtol=1e-6, atol=1e-9)
        # A start elsewhere ends in the same place.
        other = growth.lasso(gram, cross, penalties, rng.standard_normal(k))
        assert np.allclose(gram @ b, gram @ other, atol=1e-6)
    assert growth.lasso(np.zeros((2, 2)), np.zeros(2), np.ones(2), np.zeros(2)).tolist() == [0, 0]


def test_sparse_fit_finds_the_change(spark):
    t = np.arange(700)
    rng = np.random.default_rng(2)
    y = 20 + 0.02 * t + np.where(t > 280, 0.08 * (t - 280), 0) + 3 * np.sin(2 * np.pi * (t + 18262) / 7) + rng.normal(0, 0.5, 700)
    df = daily(spark, y)
    trend = growth.fit_sparse(df, yearly=0, weekly=2)
    changes = np.array([w for c, w in trend.fit.groups["trend"] if c != "_t"])
    assert 1 <= (changes != 0).sum() < 18
    # Most of the change lies where it was made.
    near = np.abs(np.array(trend.fit.knots) * 699 - 280) < 60
    assert np.abs(changes[near]).sum() > 0.6 * np.abs(changes).sum()
    assert max(r.violation for r in growth.sparse_equations(trend, df).collect()) < 1e-8
    table = {r.step: r for r in trend.path_table(spark).collect()}
    assert table[0].n_changes <= 1 and sum(r.best for r in table.values()) == 1
    assert min(table.values(), key=lambda r: (r.tail_mse, -r.strength)).best
    ahead = forecast.forecast_additive(trend.fit, series.future_frame(df, "2022-03-01", "day"))
    last = ahead.orderBy(F.desc("ds")).first()
    assert abs(last.trend - (20 + 0.02 * 790 + 0.08 * 510)) < 8


def test_simulated_interval_grows_and_repeats(spark):
    df = daily(spark, range(400))
    knots = tuple(0.8 * (i + 1) / 26 for i in range(25))
    fit = forecast.AdditiveFit(FIRST, 399.0, {"trend": (("_t", 399.0), ("_h0", 40.0), ("_h1", -20.0))}, 0.0, 1.0, knots, {})
    last = FIRST + timedelta(days=399)
    dates = series.future_frame(df, "2022-01-01", "day")
    plain = forecast.forecast_additive(fit, dates)
    got = growth.with_simulated_interval(fit, plain, last, paths=300).orderBy("ds").collect()
    width = np.array([r.yhat_upper - r.yhat_lower for r in got])
    assert np.allclose(width[:400], 2 * growth.Z80)
    ahead = width[400:]
    assert len(ahead) == 332 and ahead[-30:].mean() > 3 * ahead[100:130].mean() > 3 * ahead[:30].mean()
    again = growth.with_simulated_interval(fit, plain.repartition(7), last, paths=300).orderBy("ds").collect()
    assert [r.yhat_upper for r in got] == pytest.approx([r.yhat_upper for r in again], abs=1e-9)
    still = forecast.AdditiveFit(FIRST, 399.0, {"trend": (("_t", 1.0),)}, 0.0, 0.0, knots, {})
    assert {r.upper for r in growth.simulated_changes(still, dates, last, paths=20).collect()} == {0.0}


def test_saturating_fit_recovers_a_curve(spark):
    months = [date(2010 + k // 12, 1 + k % 12, 1) for k in range(96)]
    days = np.array([(m - months[0]).days for m in months]) / (months[-1] - months[0]).days
    season = np.array([0.2 * np.sin(2 * np.pi * (m - date(1970, 1, 1)).days / 365.25) for m in months])
    y = 500 / (1 + np.exp(-(-2 + 6 * days + season)))
    df = spark.createDataFrame([(m, float(v)) for m, v in zip(months, y)], "ds date, y double")
    fit = growth.fit_saturating(df, 500.0)
    assert np.allclose(fit.beta, [-2, 6, 0.2, 0, 0, 0], atol=1e-6) and fit.spread < 1e-6
    noisy = df.withColumn("y", F.col("y") + 10 * F.sin(F.month("ds") * 7.0))
    fit = growth.fit_saturating(noisy, 500.0)
    scores = growth.saturating_equations(fit, noisy).collect()
    assert [r.n for r in scores] == [96] * 6 and max(abs(r.score) for r in scores) < 1e-6
    ahead = growth.forecast_saturating(fit, series.future_frame(df, "2040-01-01", "month")).collect()
    assert all(0 < r.yhat_lower < r.yhat < r.yhat_upper < 500 for r in ahead)


# --- out-of-bag votes


def test_poisson_draws(spark):
    df = spark.range(4000).select(F.concat(F.lit("j"), "id").alias("id"))
    got = df.select(*[bagging.draws(t).alias(f"d{t}") for t in range(5)]).toPandas().to_numpy()
    assert abs(got.mean() - 1) < 0.03 and abs(got.var() - 1) < 0.06
    assert abs((got == 0).mean() - np.exp(-1)) < 0.015 and got.max() >= 4
    assert len({tuple(r) for r in got.T}) == 5


def test_trees_vote_only_on_rows_they_did_not_see(spark):
    rng = np.random.default_rng(3)
    rows = [(f"j{i % 150}", float(a), float(b), int(a + 0.3 * b > 0), i) for i, (a, b) in enumerate(rng.standard_normal((300, 2)))]
    rows.append((None, 0.0, 0.0, 1, 300))
    df = spark.createDataFrame(rows, "id string, a double, b double, label int, row int").repartition(4)
    bag = bagging.fit_bag(df, ["a", "b"], numTrees=30, minInstancesPerNode=2, maxDepth=5)
    votes = bagging.oob_votes(bag, df).cache()
    drawn = df.select("row", F.array(*[bagging.draws(t) for t in range(30)]).alias("d")).collect()
    want = {r.row: [t for t, n in enumerate(r.d) if n == 0] for r in drawn}
    got = {r.row: r for r in votes.collect()}
    assert {k: r.voters for k, r in got.items()} == want and len(got) == 301
    # All rows of a journey enter a tree together.
    assert all(got[i].voters == got[i + 150].voters for i in range(150))
    one = bag.trees[0]
    assert one.getNumTrees == 1
    found = bagging.oob_accuracy(votes).first()
    assert found.n_rows == 301 and found.n_voted == sum(bool(v) for v in want.values())
    assert found.accuracy > 0.85 and found.brier < 0.15
    few = bagging.oob_votes(bagging.Bag(bag.trees[:1], bag.features, bag.key, bag.seed), df).collect()
    assert all((r.p is None) == (r.voters == []) for r in few) and any(r.p is None for r in few)


# --- tables that grow


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_daily_states_grow(spark):
    rng = np.random.default_rng(4)
    data = [(FIRST + timedelta(days=int(d)), int(u), float(v)) for d, u, v in zip(rng.integers(0, 40, 900), rng.integers(0, 50, 900), rng.random(900))]
    data.append((None, 1, 1.0))
    log = spark.createDataFrame(data, "day date, user long, v double")
    path = scratch_path(spark, "log")
    log.write.parquet(path)
    asked = []

    def source(first):
        asked.append(first)
        df = spark.read.parquet(path)
        return df if first is None else df.where(F.col("day") >= F.lit(first))

    kept = {
        "n": incremental.counted(),
        "low": incremental.counted(F.col("v") < 0.5),
        "most": incremental.greatest("v"),
        "least": incremental.least("v"),
        "total": incremental.summed(F.col("v").cast("decimal(12,6)")),
        "users": incremental.distinct_estimate("user"),
    }
    grown = incremental.DailyStates(spark, scratch_path(spark, "grown"), "day", kept)
    with pytest.raises(ValueError):
        grown.table()
    assert grown.covered() is None
    assert grown.extend(source, FIRST + timedelta(days=9)) and grown.covered() == FIRST + timedelta(days=9)
    assert grown.extend(source, FIRST + timedelta(days=24))
    before = grown.folders()
    assert grown.extend(source) and not grown.extend(source)
    assert asked == [None, FIRST + timedelta(days=10), FIRST + timedelta(days=25), FIRST + timedelta(days=40)]
    assert grown.folders()[:2] == before  # folders that are alive are never changed

    def at_once(df, *keys):
        return df.where("day IS NOT NULL").groupBy(*keys).agg(
            F.count("*"), F.count_if(F.col("v") < 0.5), F.max("v"), F.min("v"),
            F.sum(F.col("v").cast("decimal(12,6)")).cast("decimal(22,6)"), F.hll_sketch_estimate(F.hll_sketch_agg("user")),
        )

    assert rows_of(grown.table()) == rows_of(at_once(log, "day"))
    assert rows_of(grown.totals()) == rows_of(at_once(log))
    half = at_once(log.where(F.col("day") >= F.lit(FIRST + timedelta(days=20))), F.month("day"))
    assert rows_of(grown.totals(F.month("day"), lo=FIRST + timedelta(days=20))) == rows_of(half)
    # Only the uncovered days are read.
    plan = grown.uncovered(source, again=5)[0]._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(day,{(FIRST + timedelta(days=35)).isoformat()})" in plan

    # Days that change late are replaced.
    late = [(FIRST + timedelta(days=38), 99, 0.9), (FIRST + timedelta(days=41), 98, 0.1)]
    spark.createDataFrame(late, "day date, user long, v double").write.mode("append").parquet(path)
    assert grown.extend(source, again=5)
    assert rows_of(grown.table()) == rows_of(at_once(spark.read.parquet(path), "day"))


def test_a_failed_extension_changes_nothing(spark, monkeypatch):
    day = spark.createDataFrame([(FIRST, 1)], "day date, v int")
    grown = incremental.DailyStates(spark, scratch_path(spark, "grown"), "day", {"n": incremental.counted()})
    grown.extend(lambda first: day)
    more = spark.createDataFrame([(FIRST + timedelta(days=1), 1)], "day date, v int")
    monkeypatch.setattr(incremental.DailyStates, "_switch", lambda self, folders: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        grown.extend(lambda first: more)
    assert rows_of(grown.table()) == [(FIRST, 1)] and len(grown.folders()) == 1
    monkeypatch.undo()
    monkeypatch.setattr(incremental, "MOST_FOLDERS", 2)
    for k in range(1, 5):
        grown.extend(lambda first: more.withColumn("day", F.date_add("day", k - 1)))
    assert len(grown.folders()) <= 3 and rows_of(grown.table()) == [(FIRST + timedelta(days=k), 1) for k in range(5)]


# --- keys that are missing, places that stay


def test_timeline_keeps_events_without_id(spark, log):
    events = log([(None, "a", 0), (None, None, 90_000), (None, "a", 90_010), ("x", "a", 5)])
    got = {r.event_id: r for r in timeline.timeline_features(events, ["a"]).collect()}
    assert [(got[k].n_events, got[k].n_unique_events, got[k].n_a) for k in range(4)] == [(1, 1, 1), (2, 1, 1), (3, 1, 2), (1, 1, 1)]


def test_places_are_the_same_whenever_rows_are_read(spark):
    path = scratch_path(spark, "rows")
    spark.range(500).select((F.col("id") % 3).alias("a")).repartition(4).write.parquet(path)
    df = spark.read.parquet(path)
    one, two = (sorted(r._p for r in spread.with_place(d, "_p").collect()) for d in (df, df.repartition(7).where("a >= 0")))
    assert len(set(one)) == 500 and len(set(two)) == 500
    assert one == sorted(r._p for r in spread.with_place(df.select("a"), "_p").collect())


def test_fine_days_keep_order_and_split(spark, log):
    rows = [("a", "x" if k % 2 else "y", k % 50) for k in range(400)] + [("b", "x", 86_400 * k) for k in range(5)]
    events = log(rows)
    fine = spread.with_fine_day(events, part_rows=40).cache()
    assert fine.count() == 405
    sizes = {r[spread.DAY]: r["count"] for r in fine.groupBy("id", spread.DAY).count().collect() if r.id == "a"}
    assert len(sizes) >= 8 and max(sizes.values()) < 120
    got = {r.event_id: r.event_number for r in spread.with_event_number(fine).collect()}
    assert got == {r.event_id: r.event_number for r in spread.with_event_number(events).collect()}
    plain = {r.event_id: tuple(r) for r in timeline.timeline_features(events, ["x"]).collect()}
    assert {r.event_id: tuple(r) for r in timeline.timeline_features(fine, ["x"]).select(*timeline.timeline_features(events, ["x"]).columns).collect()} == plain
    assert spread.with_fine_day(events.limit(0)).count() == 0


# --- logs that arrive in pieces


def test_states_of_a_log_that_arrives_in_pieces(spark, log):
    day = 86_400
    pieces = [
        [("fails", "a", 0), ("ships", "a", 0), ("back", "a", 0), ("ships", "buy", day)],
        [("open", "a", 9 * day), ("open", "a", 9 * day)],
        [("back", "a", 10 * day), ("open", "a", 10 * day + 5), (None, "a", 10 * day)],
    ]
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))

    def run():
        stream = stream_events(spark, folder, log([("x", "a", 0)]).schema)
        changes = stream_journeys.journey_changes(stream, "buy", 7)
        stream_journeys.run_to_folder(changes, out, state, "update").awaitTermination()
        return {r.id: (r.n_events, r.final_outcome) for r in stream_journeys.latest_states(changes, out).collect()}

    seen = []
    for piece in pieces:
        log(piece).coalesce(1).write.mode("append").parquet(folder)
        seen.append(run())
    assert seen[0] == {"fails": (1, "incomplete"), "ships": (2, "success"), "back": (1, "incomplete")}
    # Silence alone turned two journeys, by their timers, and one of them returned.
    assert seen[1]["fails"] == (1, "failure") and seen[1]["back"] == (1, "failure") and seen[1]["open"] == (2, "incomplete")
    assert seen[2] == {
        "fails": (1, "failure"), "ships": (2, "success"), "back": (2, "incomplete"), "open": (3, "incomplete"), None: (1, "incomplete"),
    }


def test_copies_in_a_stream_are_dropped_and_forgotten(spark, log):
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    log([("a", "x", 0), ("a", "x", 0), ("a", "y", 0), ("b", "x", 100)]).coalesce(1).write.parquet(folder)
    log([("a", "x", 5_000), ("b", "x", 100), ("b", "x", 100)]).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_journeys.deduplicated(stream_events(spark, folder, log([("x", "a", 0)]).schema), delay="1 hour")
    stream_journeys.run_to_folder(stream, out, state).awaitTermination()
    got = sorted((r.id, r.event_name, r.event_timestamp.minute) for r in stream_journeys.written_rows(stream, out).collect())
    assert len(got) == 4 and [g[:2] for g in got] == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]
    with pytest.raises(ValueError):
        stream_journeys.deduplicated(stream, ["id"])


def test_journeys_share_state_rows(spark, log):
    day = 86_400
    folder, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    ids = [f"j{i}" for i in range(200)]
    pieces = [
        [(i, "buy" if k % 4 == 0 else "a", k) for k, i in enumerate(ids)],
        [(i, "a", 5 * day + k) for k, i in enumerate(ids) if k % 4 == 1],
        [(None, "a", 9 * day)],
    ]
    for piece in pieces:
        log(piece).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_events(spark, folder, log([("x", "a", 0)]).schema)
    changes = stream_journeys.journey_changes(stream, "buy", 7, groups=5)
    running = stream_journeys.run_to_folder(changes, out, state, "update")
    running.awaitTermination()
    # Python is called per state row, so their number must not follow that of journeys.
    assert running.lastProgress.stateOperators[0].numRowsTotal <= 5
    wanted = {None: (1, "incomplete", 1)} | {
        i: [(1, "success", 1), (2, "incomplete", 2), (1, "failure", 2), (1, "failure", 2)][k % 4] for k, i in enumerate(ids)
    }
    got = {r.id: (r.n_events, r.final_outcome, r.version) for r in stream_journeys.latest_states(changes, out).collect()}
    assert got == wanted
    targets = {r.id: r.first_target_us is not None for r in stream_journeys.latest_states(changes, out).collect()}
    assert targets == {i: w[1] == "success" for i, w in wanted.items()}

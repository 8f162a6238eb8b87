"""Models on the small tables: counts, ranges, determinism and averages."""

from __future__ import annotations

import threading

import pytest
from conftest import SF_SMALL, records
from pyspark.sql import functions as F

from catalog import queries as q
from footfall.operators import explain, models, sampling, timeline
from footfall.plans import comparison, journeys
from footfall.session import materialize
from footfall.sources import driver_tables as dt


@pytest.fixture(scope="module")
def table(spark):
    df = journeys.training_snapshots(dt.event_log(spark, SF_SMALL), dt.NAMES, dt.TARGET, dt.INACTIVITY)
    return materialize(sampling.with_folds(df, "label"), "test-training")


@pytest.fixture(scope="module")
def columns(table):
    return models.feature_columns(table, ["n_purchase", "last_is_purchase"])


@pytest.fixture(scope="module")
def forest(table, columns):
    return models.fit_rf(table, columns, numTrees=10, maxDepth=4, minInstancesPerNode=2)


def test_features_hide_the_outcome(columns):
    assert "n_purchase" not in columns and "label" not in columns and "n_events" in columns


def test_scores(table, columns, forest):
    scored = models.score(forest, table)
    assert scored.count() == table.count()
    assert scored.where("p < 0 or p > 1").count() == 0
    again = models.score(models.fit_rf(table, columns, numTrees=10, maxDepth=4, minInstancesPerNode=2), table)
    assert records(scored.select("id", "p"), "id") == records(again.select("id", "p"), "id")
    base = table.agg(F.avg("label")).first()[0]
    assert models.brier(scored).first()[0] <= base * (1 - base) + 1e-9


def test_importances(spark, columns, forest):
    rows = records(models.importances(forest, spark), "rank")
    assert {r["feature"] for r in rows} == set(columns)
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)


def test_cross_validation(table, columns):
    rows = records(models.cross_validate(lambda d: models.fit_rf(d, columns, numTrees=3, maxDepth=3), table, 3), "fold")
    assert [r["fold"] for r in rows] == [-1, 0, 1, 2]
    assert rows[0]["brier"] == pytest.approx(sum(r["brier"] for r in rows[1:]) / 3)


def test_folds_are_fitted_side_by_side(table, columns):
    meet = threading.Barrier(3)

    def fit(d):
        return models.fit_rf(d, columns, numTrees=3, maxDepth=3)

    def fit_together(d):
        meet.wait(30)
        return fit(d)

    rows = records(models.cross_validate(fit_together, table, 3), "fold")
    for i, r in enumerate(rows[1:]):
        held = models.score(fit(table.where(F.col("fold") != i)), table.where(F.col("fold") == i))
        assert r == pytest.approx({**models.evaluate(held).first().asDict(), "fold": i})


def test_tuning_marks_the_best(table, columns):
    settings = [{"maxIter": 2, "stepSize": 0.1, "maxDepth": 2}, {"maxIter": 3, "stepSize": 0.2, "maxDepth": 3}]
    results, model = models.tune_gbt(table, columns, settings)
    rows = results.collect()
    assert [r["best"] for r in rows].count(True) == 1
    assert min(rows, key=lambda r: r["brier"])["best"]
    assert models.score(model, table).where("p is null").count() == 0


def test_search_follows_the_error_paths(table, columns):
    settings = [{"maxIter": 3, "stepSize": 0.3, "maxDepth": 2}, {"maxIter": 9, "stepSize": 0.3, "maxDepth": 3}]
    found = models.search_gbt(table, columns, settings, fold=1, patience=2, bins=8)
    held = records(table.where("fold = 1").select("id", "label"), "id")
    paths = records(found.path, "draw", "round")
    for r in found.results.collect():
        scored = records(found.scores.where(F.col("draw") == r["draw"]), "id")
        assert [(x["id"], x["label"]) for x in scored] == [(x["id"], x["label"]) for x in held]
        assert r["brier"] == pytest.approx(sum((x["p"] - x["label"]) ** 2 for x in scored) / len(scored))
        losses = [x["log_loss"] for x in paths if x["draw"] == r["draw"]]
        assert losses[r["rounds"] - 1] == min(losses)
        assert len(losses) >= min(r["max_iter"], r["rounds"] + 2)
    best = found.results.where("best").first()
    assert found.model.stages[-1].getNumTrees == best["rounds"]
    with pytest.raises(ValueError, match="no rows"):
        models.search_gbt(table, columns, settings, fold=99)


def test_rounds_double_until_the_loss_has_risen_for_long():
    class Fitted:
        def __init__(self, rounds):
            self.rounds = rounds

        def evaluateEachIteration(self, _):
            return [abs(r - 7) + 1.0 for r in range(1, self.rounds + 1)]

    asked = []

    def fit(rounds):
        asked.append(rounds)
        return Fitted(rounds)

    model, losses = models.fit_until_worse(fit, None, 100, 3)
    assert (asked, model.rounds, len(losses)) == ([6, 12, 7], 7, 12)
    asked.clear()
    model, losses = models.fit_until_worse(fit, None, 5, 3)
    assert (asked, model.rounds) == ([5], 5)


def test_random_settings_stay_in_range():
    drawn = models.draw_settings()
    assert len(drawn) == 15 and drawn == models.draw_settings()
    assert all(50 <= s["maxIter"] <= 300 and 0.05 <= s["stepSize"] <= 0.3 and 3 <= s["maxDepth"] <= 8 for s in drawn)


def test_dependence_is_the_mean_of_the_curves(table, forest):
    grid = explain.value_grid(table, "journey_duration_days", 4)
    curves = explain.ice(forest, table, "journey_duration_days", grid)
    rows = records(curves)
    assert len(rows) == table.count() * len({r["value"] for r in rows})
    for r in explain.pdp(curves).collect():
        ps = [c["p"] for c in rows if c["value"] == r["value"]]
        assert r["p"] == pytest.approx(sum(ps) / len(ps))


def test_profiles_include_the_own_value(table, forest):
    scored = models.score(forest, table)
    rows = explain.extreme_rows(scored)
    out = explain.cp_profile(forest, rows, "n_events", explain.value_grid(table, "n_events", 4)).collect()
    for name in ("highest", "lowest"):
        own = [r for r in out if r["profile"] == name and r["value"] == r["baseline_value"]]
        assert len(own) == 1 and own[0]["p"] == pytest.approx(own[0]["baseline_p"])


def test_probability_timeline(spark, forest):
    events = dt.event_log(spark, SF_SMALL)
    rows = records(explain.probability_timeline(forest, events, dt.NAMES), "id", "event_number")
    assert len(rows) == events.count()
    before = {}
    for r in rows:
        assert r["probability_delta"] == pytest.approx(r["p"] - before.get(r["id"], 0.0))
        before[r["id"]] = r["p"]


def test_timeline_scores_every_event_once(spark):
    events = dt.event_log(spark, SF_SMALL)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def p(n):
        calls.add(1)
        return 1 / (n + 1)

    rows = explain.probability_timeline(lambda df: df.withColumn("p", p("n_events")), events, dt.NAMES).collect()
    assert len(rows) == calls.value == events.count()


def test_open_journeys_are_all_scored(spark, forest):
    events = dt.event_log(spark, SF_SMALL)
    ids = q.labels(events).where("final_outcome = 'incomplete'").select("id")
    ids = ids.unionByName(spark.createDataFrame([("never seen",)], "id string"))
    scored = journeys.score_open(forest, events, ids, dt.NAMES)
    assert scored.count() == ids.count()
    assert scored.where("id = 'never seen' and p is not null").count() == 1


def test_template_scores_are_complete(spark, forest, table):
    template = spark.createDataFrame([("never seen", 0)] + [(r["id"], i + 1) for i, r in enumerate(table.limit(3).collect())], "id string, pos int")
    out = records(journeys.score_template(forest, table, template), "pos")
    assert [r["pos"] for r in out] == [0, 1, 2, 3] and all(0 <= r["p"] <= 1 for r in out)


def test_plotted_feature_must_exist(spark, table, forest):
    assert explain.plotted_feature(models.importances(forest, spark), table) in table.columns
    with pytest.raises(ValueError):
        explain.plotted_feature(models.importances(forest, spark), table, 10**6)


def test_variants(table, columns):
    train, test = table.where("fold <> 0"), table.where("fold = 0")
    metrics, both = comparison.compare_variants(
        train, test, {"one": columns[:2], "all": columns}, fold=1, maxIter=2, maxDepth=2
    )
    rows = records(metrics, "n_features")
    assert [r["variant"] for r in rows] == ["one", "all"] and rows[0]["pred_n"] == test.count()
    assert both.join(train, "id", "left_semi").isEmpty()
    assert both.where("abs(delta - (p_b - p_a)) > 1e-12").count() == 0


@pytest.mark.parametrize("part_rows, most", [(10**6, 1), (150, 2), (1, 6)])
def test_variant_fits_have_parts_by_rows(spark, monkeypatch, part_rows, most):
    train = spark.range(0, 300, 1, 6).selectExpr(
        "CAST(id AS STRING) AS id", "CAST(id % 2 AS INT) AS label", "CAST(1 + id % 4 AS INT) AS fold", "id * 1.5D AS x"
    )
    seen, fit = [], comparison.fit_gbt

    def watched(rows, features, **params):
        seen.append((rows.count(), rows.rdd.getNumPartitions()))
        return fit(rows, features, **params)

    monkeypatch.setattr(comparison, "FIT_ROWS", part_rows)
    monkeypatch.setattr(comparison, "fit_gbt", watched)
    test = train.selectExpr("concat('t', id) AS id", "label", "fold", "x")
    _, both = comparison.compare_variants(train, test, {"a": ["x"], "b": ["x"]}, fold=1, maxIter=1, maxDepth=1)
    assert sorted(seen) == [(225, most)] * 2 + [(300, most)] * 2
    assert both.count() == 300


def test_picked_journey_prefers_the_ranges(spark, log):
    df = log([("in", "x", i * 3600) for i in range(10)] + [("out", "x", i) for i in range(40)])
    labels = spark.createDataFrame([("in", "failure"), ("out", "failure")], "id string, final_outcome string")
    assert timeline.pick_journey(df, labels, 10, 0.3, (5, 20), (0.1, 1.0)).first()["id"] == "in"
    assert timeline.pick_journey(df, labels, 39, 0.0, (500, 900), (0.1, 1.0)).first()["id"] == "out"


@pytest.mark.parametrize("name", ["gentle_monthly_forecast", "poisson_coefficients", "additive_forecast", "orders_with_calendar"])
def test_forecast_queries_have_rows(spark, name):
    assert q.QUERIES[name](spark, SF_SMALL).count() > 0


def test_snapshot_model_holds_a_fold_out(spark):
    rows = q.QUERIES["snapshot_model_scores"](spark, SF_SMALL).collect()
    held = [r for r in rows if r["part"] == "held out"]
    assert held and len(held) < len(rows) and all(0 <= r["p"] <= 1 for r in rows)
    assert len({r["snapshot_id"] for r in held}) == len(held)

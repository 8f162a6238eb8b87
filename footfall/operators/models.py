"""Tree models on feature tables, with scoring, tuning and cross-validation."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalars import to_class
from footfall.operators.clean import numeric_columns
from footfall.operators.metrics import brier, evaluate
from footfall.schema import ID, LEAKY_COLUMNS
from footfall.session import materialize

NOT_FEATURES = ("id", "snapshot_id", "final_outcome", "label", "fold", "is_valid", "p")

# The forest and boosting settings in use.
FOREST_SETTINGS = {
    "baseline": {"numTrees": 250, "minInstancesPerNode": 10},
    "profiles": {"numTrees": 150, "minInstancesPerNode": 10},
    "timeline": {"numTrees": 250, "minInstancesPerNode": 8},
    "first": {"numTrees": 200, "minInstancesPerNode": 1},
    "snapshot": {"numTrees": 100, "maxDepth": 15},
}
BOOST_SETTINGS = {
    "snapshot": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6},
    "calendar": {"maxIter": 150, "stepSize": 0.08, "maxDepth": 6, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9"},
    "explain": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
}


def feature_columns(df: DataFrame, exclude: Sequence[str] = LEAKY_COLUMNS) -> list[str]:
    """Numeric columns that are neither keys, labels nor known to leak."""
    skip = {*NOT_FEATURES, *exclude}
    return [c for c in numeric_columns(df) if c not in skip]


def _fit(df: DataFrame, features: Sequence[str], classifier) -> PipelineModel:
    columns = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep")
    model = Pipeline(stages=[columns, classifier]).fit(df)
    model.feature_names = list(features)
    return model


def fit_rf(df: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42, **params) -> PipelineModel:
    """Random forest with probability output."""
    # Each row remembers its node in every tree, so deep trees are not walked again per level.
    speed = {"cacheNodeIds": True, "maxMemoryInMB": 1024}
    settings = {"maxDepth": 12, "featureSubsetStrategy": "sqrt", **speed, **FOREST_SETTINGS["baseline"], **params}
    return _fit(df, features, RandomForestClassifier(labelCol=label, featuresCol="_x", seed=seed, **settings))


def fit_gbt(df: DataFrame, features: Sequence[str], label: str = "label", seed: int = 42, **params) -> PipelineModel:
    """Gradient-boosted trees."""
    settings = {**BOOST_SETTINGS["snapshot"], **params}
    return _fit(df, features, GBTClassifier(labelCol=label, featuresCol="_x", seed=seed, **settings))


def score(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    """Probability of success beside the input columns."""
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability")[1].alias(name))


def with_class(df: DataFrame, p: str = "p", t: float = 0.5) -> DataFrame:
    return df.withColumn("predicted", to_class(p, t))


def importances(model: PipelineModel, spark) -> DataFrame:
    """Impurity-based importance of every feature, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((n, float(v)) for n, v in zip(model.feature_names, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(
        [(i, n, v) for i, (n, v) in enumerate(rows, start=1)], "rank int, feature string, importance double"
    )


def cross_validate(
    fit: Callable[[DataFrame], PipelineModel], df: DataFrame, k: int = 5, label: str = "label", at_once: int = 3
) -> DataFrame:
    """Metrics per fold of a table with a ``fold`` column, and their mean as fold -1.

    ``at_once`` folds are fitted side by side, since a single fit is a chain of jobs with
    few tasks; the driver holds the trees of so many forests as they grow. Held-out rows are scored once: their scores are written, and all measures
    come from these.
    """

    def held_out(i: int) -> DataFrame:
        model = fit(df.where(F.col("fold") != i))
        scored = score(model, df.where(F.col("fold") == i)).select(label, "p")
        return evaluate(materialize(scored, "fold-scores"), label).withColumn("fold", F.lit(i))

    with ThreadPool(min(k, at_once)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(held_out), range(k), chunksize=1)
    folds = reduce(DataFrame.unionByName, parts)
    means = folds.agg(*[F.avg(c).alias(c) for c in folds.columns if c != "fold"]).withColumn("fold", F.lit(-1))
    return folds.unionByName(means)


def draw_settings(n: int = 15, seed: int = 42) -> list[dict]:
    """Random boosting settings: rounds 50-300, step 0.05-0.3, depth 3-8."""
    rng = random.Random(seed)
    return [
        {"maxIter": rng.randint(50, 300), "stepSize": rng.uniform(0.05, 0.3), "maxDepth": rng.randint(3, 8)}
        for _ in range(n)
    ]


@dataclass(frozen=True)
class Tuning:
    """What a random search found.

    ``results`` has one row per draw, ``scores`` the held-out rows as each draw scores
    them (``draw, <key>, label, p``), ``path`` the held-out log loss of every draw after
    every round that was tried (``draw, round, log_loss``); ``model`` is the best draw,
    fitted again on all rows.
    """

    results: DataFrame
    scores: DataFrame
    path: DataFrame
    model: PipelineModel


def fit_until_worse(
    fit: Callable[[int], GBTClassificationModel], held: DataFrame, most: int, patience: int
) -> tuple[GBTClassificationModel, list[float]]:
    """The model of ``fit(rounds)`` with the lowest held-out loss, and the loss after every round.

    More rounds are tried, twice as many each time, until the lowest loss lies
    ``patience`` rounds back or ``most`` rounds are done. Boosting with one seed repeats
    its first trees, so a longer fit continues the path of a shorter one.
    """
    rounds = min(most, 2 * patience)
    while True:
        model = fit(rounds)
        errors = model.evaluateEachIteration(held)
        lowest = min(range(rounds), key=errors.__getitem__) + 1
        if rounds == most or lowest + patience <= rounds:
            break
        rounds = min(most, 2 * rounds)
    return (model if lowest == rounds else fit(lowest)), errors


def search_gbt(
    df: DataFrame,
    features: Sequence[str],
    settings: Sequence[dict] | None = None,
    fold: int = 0,
    seed: int = 42,
    bins: int = 32,
    patience: int = 20,
    at_once: int = 8,
    label: str = "label",
    key: str = ID,
) -> Tuning:
    """Random search for boosting settings on one held-out fold, by Brier score.

    The features are cut into ``bins`` quantile ranges once and written as one table of
    vectors that all draws share, so no draw goes back to the features. The holdout is a
    whole fold of ids, so snapshots of one journey never stand on both sides. A draw
    keeps its rounds up to the lowest held-out loss (:func:`fit_until_worse`). ``at_once``
    fits run side by side, since the jobs of a single fit are short. The best draw is
    fitted again on all rows with the rounds it kept. A fold without rows is refused.
    """
    spark = df.sparkSession
    settings = draw_settings(seed=seed) if settings is None else list(settings)
    cut = QuantileDiscretizer(
        inputCols=list(features),
        outputCols=[f"_bin_{i}" for i in range(len(features))],
        numBuckets=bins,
        handleInvalid="keep",
    ).fit(df)
    together = VectorAssembler(inputCols=cut.getOutputCols(), outputCol="_x")
    vectors = together.transform(cut.transform(df)).select(
        key, F.col(label).alias("label"), "_x", (F.col("fold") == fold).alias("_held")
    )
    shared = materialize(vectors, "tuning-vectors")
    held, train = shared.where("_held"), shared.where("NOT _held")
    if held.isEmpty():
        raise ValueError(f"fold {fold} has no rows to hold out")

    def booster(s: dict, rounds: int) -> GBTClassifier:
        return GBTClassifier(
            labelCol="label", featuresCol="_x", seed=seed, maxBins=bins + 1, **{**s, "maxIter": rounds}
        )

    def attempt(numbered: tuple[int, dict]):
        i, s = numbered
        model, errors = fit_until_worse(lambda n: booster(s, n).fit(train), held, s["maxIter"], patience)
        scored = model.transform(held).select(
            F.lit(i).alias("draw"), key, "label", vector_to_array("probability")[1].alias("p")
        )
        return materialize(scored, "tuning-scores"), errors, model.getNumTrees

    with ThreadPool(at_once) as pool:
        tried = pool.map(inheritable_thread_target(spark)(attempt), list(enumerate(settings)), chunksize=1)
    scores = reduce(DataFrame.unionByName, [t for t, _, _ in tried])
    path = spark.createDataFrame(
        [(i, r, float(e)) for i, (_, errors, _) in enumerate(tried) for r, e in enumerate(errors, start=1)],
        "draw int, round int, log_loss double",
    )
    loss = {r["draw"]: r["brier"] for r in brier(scores.groupBy("draw")).collect()}
    rows = [
        (i, s["maxIter"], float(s["stepSize"]), s["maxDepth"], kept, loss[i])
        for i, (s, (_, _, kept)) in enumerate(zip(settings, tried))
    ]
    best = min(rows, key=lambda r: (r[-1], r[0]))[0]
    results = spark.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "draw int, max_iter int, step_size double, max_depth int, rounds int, brier double, best boolean",
    )
    final = booster(settings[best], rows[best][4]).fit(shared)
    model = PipelineModel([cut, together, final])
    model.feature_names = list(features)
    return Tuning(results, scores, path, model)


def tune_gbt(
    df: DataFrame, features: Sequence[str], settings: Sequence[dict] | None = None, fold: int = 0, seed: int = 42
) -> tuple[DataFrame, PipelineModel]:
    """The results and the refitted best model of :func:`search_gbt`."""
    found = search_gbt(df, features, settings, fold, seed)
    return found.results, found.model

"""Profiles of a fitted model: ICE, partial dependence, ceteris paribus, timelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.clean import closest_to
from footfall.operators.features import align_columns
from footfall.operators.models import score
from footfall.operators.quantiles import quantiles
from footfall.operators.timeline import timeline_features, with_delta, with_elapsed
from footfall.schema import ID, TIE, TS
from footfall.session import materialize

def scored(model: PipelineModel | Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """Add ``p`` by a fitted model or by any function of a table, such as a formula."""
    return score(model, df) if isinstance(model, PipelineModel) else model(df)


def value_grid(df: DataFrame, feature: str, points: int = 12, digits: int = 6) -> Column:
    """Distinct rounded quantiles of a feature as an array of at most ``points`` values."""
    probs = {f"q{i}": i / (points - 1) for i in range(points)}
    cuts = quantiles(df, feature, probs)
    grid = F.array_sort(F.array_distinct(F.array(*[F.round(c, digits) for c in probs])))
    return cuts.select(grid.alias("grid")).scalar()


def plotted_feature(importance: DataFrame, df: DataFrame, min_distinct: int = 5) -> str:
    """The most important feature with more than ``min_distinct`` values.

    One row per feature reaches the driver; sketches count the values, exactly
    for counts as small as these.
    """
    ranked = [r["feature"] for r in importance.orderBy("rank").collect()]
    sizes = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.01).alias(f"f{i}") for i, c in enumerate(ranked)]).first()
    for i, c in enumerate(ranked):
        if sizes[i] > min_distinct:
            return c
    raise ValueError(f"no feature has more than {min_distinct} values")


def sweep(sample: DataFrame, grid: Column | Sequence[float], feature: str) -> DataFrame:
    """Each row once per grid value, with the feature replaced by it.

    The grid is a short array on every row, so this explodes in place instead of
    joining two tables. Row count grows by the grid size only.
    """
    values = grid if isinstance(grid, Column) else F.array(*[F.lit(float(v)) for v in grid])
    rest = [F.col(f"`{c}`") for c in sample.columns if c != feature]
    return sample.select(*rest, F.explode(values).alias(feature))


def ice(model: PipelineModel, rows: DataFrame, feature: str, grid, key: str = ID) -> DataFrame:
    """``key, value, p``: the prediction of every row at every grid value."""
    swept = scored(model, sweep(rows, grid, feature))
    return swept.select(key, F.col(f"`{feature}`").alias("value"), "p")


def pdp(curves: DataFrame) -> DataFrame:
    """Average of the ICE curves per value."""
    return curves.groupBy("value").agg(F.avg("p").alias("p"), F.count("*").alias("n"))


def profile_rows(predicted: DataFrame, targets: dict[str, float], key: str = ID) -> DataFrame:
    """For each label the row whose prediction is nearest to the target."""
    parts = [closest_to(predicted, "p", t, key).withColumn("profile", F.lit(name)) for name, t in targets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def extreme_rows(predicted: DataFrame, key: str = ID) -> DataFrame:
    """The rows with the highest and the lowest prediction."""
    high = predicted.orderBy(F.desc("p"), key).limit(1).withColumn("profile", F.lit("highest"))
    low = predicted.orderBy(F.asc("p"), key).limit(1).withColumn("profile", F.lit("lowest"))
    return high.unionByName(low)


def cp_profile(model: PipelineModel, rows: DataFrame, feature: str, grid: Column) -> DataFrame:
    """Predictions of chosen rows over the grid and their own value.

    ``rows`` comes from :func:`profile_rows` or :func:`extreme_rows`, with the
    baseline prediction in ``p``.
    """
    base = rows.withColumns({"baseline_value": F.col(f"`{feature}`").cast("double"), "baseline_p": F.col("p")}).drop("p")
    own = base.agg(F.collect_set("baseline_value")).scalar()
    full = F.sort_array(F.array_union(grid, own))
    swept = scored(model, sweep(base, full, feature))
    return swept.select("profile", ID, F.col(f"`{feature}`").alias("value"), "p", "baseline_value", "baseline_p")


def probability_timeline(model: PipelineModel, events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Probability after every event of every given journey, with its change.

    The scored events are written once: numbers, start and change of a journey each read
    them again, and neither features nor trees should be computed for every one of these.
    """
    features = timeline_features(events, names)
    keys = [ID, TS, TIE, "event_name"]
    if isinstance(model, PipelineModel):
        features = align_columns(features, [*keys, *model.feature_names])
    known = materialize(scored(model, features).select(*keys, "p"), "scored-events")
    return with_delta(with_elapsed(known), "p")

"""End-to-end flows over an event log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalars import clip
from footfall.functions.times import shift_days
from footfall.operators.clean import dedup_events
from footfall.operators.features import align_columns, baseline_features, fill_zero, flatten_journeys, with_label
from footfall.operators.outcomes import (
    journey_status,
    label_outcomes,
    latest,
    outcome_column,
    restrict_events,
    status_from_days,
)
from footfall.operators.sampling import balance_classes, downsample_success, with_folds
from footfall.operators.snapshots import (
    bounds_from_status,
    day_states,
    days_of_states,
    features_at,
    k_cutoffs,
    single_cutoff,
    snapshot_k,
)
from footfall.operators.spread import attach_journey, journey_days
from footfall.schema import FEATURE_EVENTS, ID, INACTIVITY_DAYS, LEAKY_COLUMNS, TARGET_EVENT, TS
from footfall.session import materialize


def clean_and_label(
    raw: DataFrame, target: str = TARGET_EVENT, inactivity_days: int = INACTIVITY_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Deduplicated events and the outcome of every journey.

    Duplicates change neither first and last times nor whether the target came,
    so outcomes are labelled from the raw log and skip the deduplication shuffle.
    """
    outcomes = label_outcomes(journey_status(raw, target, latest(raw)), inactivity_days)
    return dedup_events(raw), outcomes


def snapshot_features(
    events: DataFrame,
    names: Sequence[str],
    target: str = TARGET_EVENT,
    inactivity_days: int = INACTIVITY_DAYS,
    by: str = "total_actions",
    seed: int = 42,
) -> DataFrame:
    """Features of up to five random past moments per closed journey, with its outcome.

    The log is read twice: once for the states of every journey and day, which are
    written and yield outcomes, bounds, cutoffs and the features of whole days, and once
    for the events of the days that hold a cutoff.
    """
    states = materialize(day_states(events, names, target), "day-states")
    days = materialize(days_of_states(states), "journey-days")
    bounds = closed_bounds(days, inactivity_days)
    chosen = k_cutoffs(snapshot_k(bounds, by), seed, keep=("final_outcome",)).drop("k_no")
    cutoffs = materialize(chosen, "cutoffs")
    return features_at(events, states, days, cutoffs, names, by=(ID, "snapshot_id", "final_outcome"))


def closed_bounds(days: DataFrame, inactivity_days: int = INACTIVITY_DAYS) -> DataFrame:
    """Bounds and outcomes of journeys that are not open any more."""
    status = status_from_days(days).withColumn("final_outcome", outcome_column(inactivity_days))
    return bounds_from_status(status.where(F.col("final_outcome") != "incomplete"), ("final_outcome",))


def single_snapshot_features(
    events: DataFrame,
    names: Sequence[str],
    target: str = TARGET_EVENT,
    inactivity_days: int = INACTIVITY_DAYS,
    seed: int = 42,
) -> DataFrame:
    """Features of one random past moment per closed journey, with its outcome."""
    states = materialize(day_states(events, names, target), "day-states")
    days = materialize(days_of_states(states), "journey-days")
    chosen = single_cutoff(closed_bounds(days, inactivity_days), seed, keep=("final_outcome",))
    cutoffs = materialize(chosen, "cutoffs")
    return features_at(events, states, days, cutoffs, names, by=(ID, "final_outcome"))


def snapshot_model(
    events: DataFrame,
    names: Sequence[str],
    target: str = TARGET_EVENT,
    inactivity_days: int = INACTIVITY_DAYS,
    leaky: Sequence[str] = LEAKY_COLUMNS,
    fold: int = 0,
    fit: Callable[[DataFrame, Sequence[str]], PipelineModel] | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """A model on down-sampled snapshot features, and its scores of the held-out fold.

    Folds are dealt by journey, so snapshots of one journey never stand on both
    sides. ``fit`` takes a table and its feature columns; by default it is a forest
    at the snapshot settings.
    """
    from footfall.operators.models import FOREST_SETTINGS, feature_columns, fit_rf, score

    def forest(df, columns):
        return fit_rf(df, columns, **FOREST_SETTINGS["snapshot"])

    # Written, since the sample counts the rows before it draws them.
    flat = materialize(snapshot_features(events, names, target, inactivity_days), "snapshot-features")
    sampled = downsample_success(flat)
    table = materialize(with_folds(with_label(sampled), "final_outcome"), "snapshot-training")
    # Gaps are null for snapshots of one event.
    table = fill_zero(table)
    model = (fit or forest)(table.where(F.col("fold") != fold), feature_columns(table, leaky))
    held = score(model, table.where(F.col("fold") == fold))
    return model, held.select(ID, "snapshot_id", "label", "p")


def open_features(events: DataFrame, outcomes: DataFrame, names: Sequence[str]) -> DataFrame:
    """Features of open journeys as of the latest event among them."""
    open_ids = outcomes.where(F.col("final_outcome") == "incomplete").select(ID)
    seen = restrict_events(events, open_ids)
    flat = flatten_journeys(seen.withColumn("cutoff_time", latest(seen)), names)
    return flat.withColumn("final_outcome", F.lit("incomplete"))


def training_labels(status: DataFrame, inactivity_days: int = INACTIVITY_DAYS) -> DataFrame:
    """``id, label, first_target_ts``: 1 for journeys with the target, 0 for those
    quiet since before the open window; all others are left out."""
    quiet = F.col("last_ts") < shift_days("as_of", -inactivity_days)
    return status.where(F.col("has_shipped") | quiet).select(
        ID, F.col("has_shipped").cast("int").alias("label"), "first_target_ts"
    )


def training_snapshots(
    events: DataFrame,
    names: Sequence[str] = FEATURE_EVENTS,
    target: str = TARGET_EVENT,
    inactivity_days: int = INACTIVITY_DAYS,
    max_rows: int = 200_000,
    seed: int = 123,
    equal: bool = False,
) -> DataFrame:
    """Baseline features and labels as known before the target.

    Positives are cut before their first target event, so journeys that start
    with it have no visible event and drop out. The log is read twice: for the
    journey-day table, which decides labels, sample and cut, and for the features.
    ``max_rows`` bounds the labelled rows a model is fitted on; ``equal`` takes as
    many of either label.
    """
    days = materialize(journey_days(events, target), "journey-days")
    labels = training_labels(status_from_days(days), inactivity_days)
    chosen = balance_classes(labels, "label", max_rows, ID, seed, equal)
    known = attach_journey(events, chosen, days=days)
    visible = known.where(F.col("first_target_ts").isNull() | (F.col(TS) < F.col("first_target_ts")))
    return baseline_features(visible, names, by=(ID, "label"))


def score_open(model: PipelineModel, events: DataFrame, ids: DataFrame, names: Sequence[str] = FEATURE_EVENTS) -> DataFrame:
    """Probability and class for every listed journey; unseen journeys have zero features."""
    from footfall.operators.models import score, with_class

    features = baseline_features(restrict_events(events, ids), names)
    full = fill_zero(ids.select(ID).distinct().join(features, ID, "left"))
    known = align_columns(full, [ID, *model.feature_names])
    return with_class(score(model, known)).select(ID, "p", "predicted")


def score_template(model: PipelineModel, snapshots: DataFrame, template: DataFrame) -> DataFrame:
    """One clipped prediction per template id; ids without features get the median."""
    from footfall.operators.models import score
    from footfall.sources.tables import conform_to_template

    scored = score(model, align_columns(snapshots, [ID, *model.feature_names])).withColumn("p", clip("p", 0.0, 1.0))
    return conform_to_template(scored.select(ID, "p"), template)

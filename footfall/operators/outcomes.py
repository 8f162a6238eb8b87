"""Journey status, outcome labels and time to the target event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.times import shift_days, whole_days_between
from footfall.operators.spread import DAY, attach, attach_journey, with_day
from footfall.schema import ID, INACTIVITY_DAYS, NAME, TARGET_EVENT, TS


def latest(events: DataFrame) -> Column:
    """Latest timestamp of a table, as a scalar.

    Duplicates do not move the maximum, so this is best taken from the raw log,
    where it costs a scan of one column.
    """
    return events.agg(F.max(TS)).scalar()


def journey_status(events: DataFrame, target: str = TARGET_EVENT, as_of: Column | None = None) -> DataFrame:
    """One row per journey: whether and when the target came, first and last time,
    actions, and whole days without activity before ``as_of``."""
    as_of = latest(events) if as_of is None else as_of
    per_journey = events.groupBy(ID).agg(
        F.count("*").alias("total_actions"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.min(F.when(F.col(NAME) == target, F.col(TS))).alias("first_target_ts"),
    )
    return per_journey.withColumns(
        {
            "has_shipped": F.col("first_target_ts").isNotNull(),
            "as_of": as_of,
        }
    ).withColumn("days_inactive", whole_days_between("as_of", "last_ts"))


def status_from_days(days: DataFrame) -> DataFrame:
    """:func:`journey_status` from the journey-day table."""
    as_of = days.agg(F.max("last_ts")).scalar()
    per_journey = days.groupBy(ID).agg(
        F.sum("n").alias("total_actions"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("first_target_ts").alias("first_target_ts"),
    )
    return per_journey.withColumns(
        {"has_shipped": F.col("first_target_ts").isNotNull(), "as_of": as_of}
    ).withColumn("days_inactive", whole_days_between("as_of", "last_ts"))


def outcome_column(inactivity_days: int = INACTIVITY_DAYS, rule: str = "elapsed") -> Column:
    """The outcome of a :func:`journey_status` row.

    ``elapsed``: failure from ``inactivity_days`` whole elapsed days on.
    ``dates``: failure when the calendar dates lie more than that apart.
    ``window``: failure when the last event is older than ``as_of`` minus the days.
    """
    quiet = {
        "elapsed": F.col("days_inactive") >= inactivity_days,
        "dates": F.datediff("as_of", "last_ts") > inactivity_days,
        "window": F.col("last_ts") < shift_days("as_of", -inactivity_days),
    }[rule]
    return F.when(F.col("has_shipped"), "success").when(quiet, "failure").otherwise("incomplete")


def label_outcomes(status: DataFrame, inactivity_days: int = INACTIVITY_DAYS, rule: str = "elapsed") -> DataFrame:
    """``id, final_outcome`` from :func:`journey_status`; rules as in :func:`outcome_column`."""
    return status.select(ID, outcome_column(inactivity_days, rule).alias("final_outcome"))


def is_open(status: DataFrame, inactivity_days: int = INACTIVITY_DAYS) -> DataFrame:
    """``id, incomplete``: no target yet and active within the last days."""
    recent = F.col("last_ts") >= shift_days("as_of", -inactivity_days)
    return status.select(ID, (~F.col("has_shipped") & recent).alias("incomplete"))


def ends_with_target(events: DataFrame, target: str = TARGET_EVENT) -> DataFrame:
    """``id, will_ship``: the last event of the journey is the target."""
    from footfall.operators.features import first_last

    return first_last(events).select(ID, (F.col("last_event_name") == target).alias("will_ship"))


def outcome_counts(outcomes: DataFrame, column: str = "final_outcome") -> DataFrame:
    return outcomes.groupBy(column).agg(F.count("*").alias("n"))


def with_outcome(df: DataFrame, outcomes: DataFrame, how: str = "inner") -> DataFrame:
    """Attach the true outcome to journey or snapshot rows."""
    return df.join(outcomes.select(ID, "final_outcome"), ID, how)


def with_outcome_events(
    events: DataFrame, outcomes: DataFrame, how: str = "inner", days: DataFrame | None = None
) -> DataFrame:
    """Attach the true outcome to every event."""
    return attach_journey(events, outcomes.select(ID, "final_outcome"), how, days)


def with_first_target(events: DataFrame, target: str = TARGET_EVENT, name: str = "first_target_ts") -> DataFrame:
    """Write the journey's first target time on each of its events, null if none."""
    first = events.where(F.col(NAME) == target).groupBy(ID).agg(F.min(TS).alias(name))
    return attach_journey(events, first, "left")


def visible_before_first(events: DataFrame, target: str = TARGET_EVENT) -> DataFrame:
    """Events strictly before the first target, or all of them if it never came."""
    cut = with_first_target(events, target, "_first")
    return cut.where(F.col("_first").isNull() | (F.col(TS) < F.col("_first"))).drop("_first")


def days_to_event(events: DataFrame, target: str = TARGET_EVENT) -> DataFrame:
    """Calendar days from the first action to the first target, per journey with one."""
    per = events.groupBy(ID).agg(
        F.min(TS).alias("first_ts"),
        F.min(F.when(F.col(NAME) == target, F.col(TS))).alias("target_ts"),
    )
    return per.where(F.col("target_ts").isNotNull()).select(
        ID, F.datediff(F.to_date("target_ts"), F.to_date("first_ts")).alias("days_to_buy")
    )


def recount_steps(events: DataFrame, name: str = "journey_steps_until_end") -> DataFrame:
    """Write the number of distinct event names of the journey on each event."""
    per = events.select(ID, NAME).distinct().groupBy(ID).agg(F.count("*").alias(name))
    return attach_journey(events, per)


def restrict_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of the given journeys, joined per journey and day."""
    return attach(with_day(events), ids.select(ID).distinct(), [ID], [DAY], "left_semi").select(*events.columns)


def exclude_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events of all other journeys, joined per journey and day."""
    return attach(with_day(events), ids.select(ID).distinct(), [ID], [DAY], "left_anti").select(*events.columns)

"""Features after every event of a journey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.times import days_between
from footfall.operators.spread import DAY, attach_journey, day_window, null_safe_join, order_columns, with_day
from footfall.schema import FEATURE_EVENTS, ID, NAME, TS


def timeline_features(events: DataFrame, names: Sequence[str] = FEATURE_EVENTS) -> DataFrame:
    """The baseline features as they stood after each event.

    Running values are the day's own running values plus the totals of earlier
    days. A name counts towards the distinct names on its first day only, at its
    first occurrence on that day. Events without a name count as events only; events
    without an id form one journey.
    """
    events = with_day(events)
    order = day_window(events).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same_name = Window.partitionBy(ID, DAY, NAME).orderBy(*order_columns(events))

    daily = events.groupBy(ID, DAY, NAME).agg(F.count("*").alias("_n"), F.min(TS).alias("_t"))
    first_day = Window.partitionBy(ID, NAME).orderBy(DAY)
    daily = daily.withColumn("_new", (F.row_number().over(first_day) == 1) & F.col(NAME).isNotNull())
    earlier = Window.partitionBy(ID).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(ID).orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_day = daily.groupBy(ID, DAY).agg(
        F.sum("_n").alias("_events"),
        F.count_if("_new").alias("_fresh"),
        F.collect_list(F.when(F.col("_new"), F.col(NAME))).alias("_fresh_names"),
        F.min("_t").alias("_t"),
        *[F.sum(F.when(F.col(NAME) == n, F.col("_n")).otherwise(0)).alias(f"_c{i}") for i, n in enumerate(names)],
    )
    carried = per_day.select(
        ID,
        DAY,
        "_fresh_names",
        F.min("_t").over(upto).alias("_start"),
        *[
            F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}")
            for c in ["_events", "_fresh", *[f"_c{i}" for i in range(len(names))]]
        ],
    )

    inside = events.withColumns(
        {"_i_events": F.count("*").over(order)}
        | {f"_i_c{i}": F.sum(F.when(F.col(NAME) == n, 1).otherwise(0)).over(order) for i, n in enumerate(names)}
    ).withColumn("_nth", F.row_number().over(same_name))
    joined = null_safe_join(inside, carried, [ID, DAY])
    fresh = (F.col("_nth") == 1) & F.array_contains("_fresh_names", F.col(NAME))
    joined = joined.withColumn("_i_fresh", F.sum(F.when(fresh, 1).otherwise(0)).over(order))
    return joined.select(
        *[c for c in events.columns if c != DAY],
        (F.col("_before_events") + F.col("_i_events")).alias("n_events"),
        (F.col("_before_fresh") + F.col("_i_fresh")).alias("n_unique_events"),
        days_between(TS, "_start").alias("journey_duration_days"),
        *[(F.col(NAME) == n).cast("int").alias(f"last_is_{n}") for n in names],
        *[(F.col(f"_before_c{i}") + F.col(f"_i_c{i}")).alias(f"n_{n}") for i, n in enumerate(names)],
    )


def with_elapsed(events: DataFrame) -> DataFrame:
    """Event number and days since the journey's start on every event."""
    from footfall.operators.spread import with_event_number

    start = events.groupBy(ID).agg(F.min(TS).alias("_start"))
    numbered = with_event_number(with_day(events))
    return (
        attach_journey(numbered, start)
        .withColumn("time_since_start_days", days_between(TS, "_start"))
        .drop("_start", DAY)
    )


def with_remaining(events: DataFrame, name: str = "journey_steps_until_end") -> DataFrame:
    """Steps left in the journey, counting down to 1 at the last event."""
    from footfall.operators.spread import with_event_number

    sizes = events.groupBy(ID).agg(F.count("*").alias("_size"))
    numbered = attach_journey(with_event_number(with_day(events), "_no"), sizes)
    return numbered.withColumn(name, F.col("_size") - F.col("_no") + 1).drop("_size", "_no", DAY)


def with_delta(timeline: DataFrame, column: str, name: str = "probability_delta") -> DataFrame:
    """Change against the journey's previous event; the first row shows its own value."""
    from footfall.operators.spread import with_previous

    out = with_previous(timeline, {"_before": column})
    return out.withColumn(name, F.col(column) - F.coalesce("_before", F.lit(0.0))).drop("_before")


def pick_journey(
    events: DataFrame,
    labels: DataFrame,
    n_events: int,
    n_days: float,
    event_range: tuple[int, int],
    day_range: tuple[float, float],
) -> DataFrame:
    """The failed journey nearest to a wanted number of events and days.

    Journeys inside both ranges come before all others; then distance decides.
    """
    return (
        events.groupBy(ID)
        .agg(F.count("*").alias("n"), days_between(F.max(TS), F.min(TS)).alias("days"))
        .join(labels.where(F.col("final_outcome") == "failure").select(ID), ID, "left_semi")
        .withColumn("score", F.abs(F.col("n") - n_events) + 0.5 * F.abs(F.col("days") - F.lit(n_days)))
        .withColumn("inside", F.col("n").between(*event_range) & F.col("days").between(*day_range))
        .orderBy(F.desc("inside"), "score", ID)
        .limit(1)
        .select(ID, "n", "days")
    )

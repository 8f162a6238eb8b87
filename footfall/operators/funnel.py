"""Event dimension, frequency, length, gap and funnel reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.scalars import plain_name
from footfall.functions.times import MICROS_PER_DAY, days_between, micros, minutes_between
from footfall.operators.clean import top_k
from footfall.operators.features import first_last
from footfall.operators.quantiles import distribution, quantiles
from footfall.operators.spread import (
    join_dimension,
    null_safe_join,
    order_columns,
    with_event_number,
    with_previous,
    with_previous_ts,
)
from footfall.schema import ID, NAME, TARGET_EVENT, TS
from footfall.session import materialize

NO_STAGE = "NA"


def with_stage(events: DataFrame, definitions: DataFrame, code: str | None = None) -> DataFrame:
    """Attach ``milestone_number`` and ``stage``; unknown events keep nulls.

    Joined on the event code where the log has one, otherwise on the name with
    parentheses removed. The dimension has one row per event name.
    """
    if code is not None:
        dim = definitions.select(F.col("event_definition_id").alias("_code"), "milestone_number", "stage")
        return join_dimension(events.withColumn("_code", F.col(code)), dim, "_code").drop("_code")
    dim = definitions.select(plain_name(NAME).alias("_plain"), "milestone_number", "stage")
    return join_dimension(events.withColumn("_plain", plain_name(NAME)), dim, "_plain").drop("_plain")


def event_frequency(events: DataFrame) -> DataFrame:
    """Events per name with the share of all events in percent."""
    counts = events.groupBy(NAME).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def top_events(events: DataFrame, k: int = 10) -> DataFrame:
    return top_k(events.groupBy(NAME).agg(F.count("*").alias("n")), "n", k, NAME)


def journey_lengths(events: DataFrame) -> DataFrame:
    """Actions, microseconds, minutes and days from first to last event per journey."""
    return events.groupBy(ID).agg(
        F.count("*").alias("total_actions"),
        (micros(F.max(TS)) - micros(F.min(TS))).alias("length_us"),
        minutes_between(F.max(TS), F.min(TS)).alias("minutes"),
        days_between(F.max(TS), F.min(TS)).alias("days"),
    )


def journey_length_stats(events: DataFrame) -> DataFrame:
    """Mean and median of minutes and actions over all journeys."""
    both = stacked(journey_lengths(events), {"minutes": "length_us", "actions": "total_actions"})
    found = distribution(both, "value", {"median": 0.5}, ["measure"])

    def of(measure: str, stat: str, unit: float = 1.0):
        return (F.max(F.when(F.col("measure") == measure, F.col(stat))) / unit).alias(f"{stat}_{measure}")

    return found.agg(
        of("minutes", "mean", 6e7), of("minutes", "median", 6e7), of("actions", "mean"), of("actions", "median")
    )


def stacked(df: DataFrame, measures: dict[str, str]) -> DataFrame:
    """``measure, value`` rows of several columns, so one pass summarises them all."""
    cells = [F.struct(F.lit(m).alias("measure"), F.col(c).cast("long").alias("value")) for m, c in measures.items()]
    return df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def six_numbers(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum."""
    return distribution(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}).select(
        "min", "q1", "median", "mean", "q3", "max"
    )


def gaps(events: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Events that have a predecessor, with the gap in microseconds."""
    timed = with_previous_ts(events, "_prev", days)
    return timed.where(F.col("_prev").isNotNull()).withColumn("gap_us", micros(TS) - micros("_prev")).drop("_prev")


def gap_stats(events: DataFrame) -> DataFrame:
    """Mean, median, p90 and p99 of the time between events, in seconds."""
    found = distribution(gaps(events).select("gap_us"), "gap_us", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return found.select(*[(F.col(c) / 1e6).alias(f"{c}_s") for c in ("mean", "p50", "p90", "p99")])


def stats_by_outcome(values: DataFrame, column: str, by: str = "final_outcome") -> DataFrame:
    """Count, mean, deviation and median of a column per outcome."""
    return distribution(values, column, {"median": 0.5}, [by]).select(by, "n", "mean", "sd", "median")


def dropout_events(events: DataFrame, k: int = 12, target: str = TARGET_EVENT) -> DataFrame:
    """Most common last event of journeys without the target, with their medians."""
    order = F.struct(*order_columns(events))
    ended = (
        events.groupBy(ID)
        .agg(
            F.bool_or(F.col(NAME) == target).alias("_hit"),
            F.max_by(NAME, order).alias("last_event_name"),
            F.count("*").alias("n_events"),
            (micros(F.max(TS)) - micros(F.min(TS))).alias("length_us"),
        )
        .where(~F.col("_hit"))
    )
    counts = top_k(ended.groupBy("last_event_name").agg(F.count("*").alias("journeys")), "journeys", k, "last_event_name")
    both = stacked(ended, {"length": "length_us", "events": "n_events"})
    medians = quantiles(both, "value", {"x": 0.5}, ["measure"]).agg(
        F.struct(
            (F.max(F.when(F.col("measure") == "length", F.col("x"))) / MICROS_PER_DAY).alias("median_duration_days"),
            F.max(F.when(F.col("measure") == "events", F.col("x"))).alias("median_events"),
        ).alias("m")
    )
    return counts.withColumn("_m", medians.scalar()).select("last_event_name", "journeys", "_m.*")


def stage_counts(events: DataFrame, definitions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Events per outcome and stage; events without a stage are their own group.

    Events shrink to one row per journey and event name before any join.
    """
    per = events.groupBy(ID, NAME).agg(F.count("*").alias("_n"))
    closed = null_safe_join(with_stage(per, definitions), outcomes, [ID])
    return closed.groupBy("final_outcome", "stage").agg(F.sum("_n").alias("n"))


def final_stage_share(events: DataFrame, definitions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Stage of the last event per outcome, as count and share."""
    last = first_last(events).select(ID, F.col("last_event_name").alias(NAME))
    closed = null_safe_join(with_stage(last, definitions), outcomes, [ID])
    counts = closed.groupBy("final_outcome", "stage").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("final_outcome"))
    return counts.withColumn("share", share)


def stage_reach(events: DataFrame, definitions: DataFrame, outcomes: DataFrame, stage: str) -> DataFrame:
    """Share of journeys per outcome with at least one event of the stage."""
    per = with_stage(events.groupBy(ID, NAME).agg(F.lit(1)).select(ID, NAME), definitions)
    reached = per.groupBy(ID).agg(F.max(F.when(F.col("stage") == stage, 1).otherwise(0)).alias("_hit"))
    return (
        null_safe_join(reached, outcomes, [ID])
        .groupBy("final_outcome")
        .agg(F.count("*").alias("journeys"), F.avg("_hit").alias("share"))
    )


def stage_paths(
    events: DataFrame,
    definitions: DataFrame,
    outcomes: DataFrame,
    k: int = 10,
    collapse: bool = False,
    page_steps: int = 1000,
) -> DataFrame:
    """The ``k`` most frequent stage chains per outcome.

    Chains are counted by a 128-bit fingerprint over (position, stage), which
    aggregates like a sum, so a journey never has to fit into one string. The
    winners are spelled out in full, in pages of ``page_steps`` stages numbered
    from 0; ``n_steps`` is the length of the chain. ``collapse`` drops repeats of
    the stage just before.
    """

    def numbered(rows):
        staged = with_stage(rows, definitions).withColumn("stage", F.coalesce("stage", F.lit(NO_STAGE)))
        if collapse:
            staged = with_previous(staged, {"_before": "stage"})
            staged = staged.where(F.col("_before").isNull() | (F.col("_before") != F.col("stage"))).drop("_before")
        return with_event_number(staged, "_pos").select(ID, "_pos", "stage")

    marks = numbered(events).groupBy(ID).agg(
        F.count("*").alias("n_steps"),
        F.bit_xor(F.xxhash64("_pos", "stage")).alias("_a"),
        F.bit_xor(F.xxhash64("stage", F.lit("path"), "_pos")).alias("_b"),
    )
    counted = (
        null_safe_join(marks, outcomes, [ID])
        .groupBy("final_outcome", "n_steps", "_a", "_b")
        .agg(F.count("*").alias("n"), F.min(ID).alias("_sample"))
    )
    best = Window.partitionBy("final_outcome").orderBy(F.desc("n"), "_sample")
    # A few rows per outcome, needed twice: to pick the sample journeys and to name them.
    winners = materialize(counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "paths")
    # Only the sample journeys are numbered again.
    samples = null_safe_join(events, winners.select(F.col("_sample").alias(ID)), [ID], "left_semi")
    texts = (
        numbered(samples)
        .groupBy(F.col(ID).alias("_sample"), F.floor((F.col("_pos") - 1) / page_steps).cast("int").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "stage"))).alias("_items"))
        .select("_sample", "page", F.array_join(F.transform("_items", lambda x: x["stage"]), " > ").alias("path"))
    )
    return null_safe_join(winners, texts, ["_sample"]).select("final_outcome", "rank", "page", "path", "n_steps", "n")

"""Point-in-time snapshots: cutoffs per journey and the range join to events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.scalars import hash_uniform
from footfall.functions.times import epoch_seconds, micros
from footfall.operators.quantiles import value_ranks
from footfall.operators.spread import DAY, day_window, null_safe_join, with_day
from footfall.schema import ID, NAME, TARGET_EVENT, TS


def journey_bounds(events: DataFrame) -> DataFrame:
    """Start, end, number of actions and length in microseconds per journey."""
    return (
        events.groupBy(ID)
        .agg(F.count("*").alias("total_actions"), F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"))
        .withColumn("journey_us", micros("end_ts") - micros("start_ts"))
    )


def snapshot_k(bounds: DataFrame, by: str = "total_actions", buckets: int = 5) -> DataFrame:
    """Add ``K = ceil(buckets * rank / N)`` with the smallest rank for ties.

    K only changes at ``buckets - 1`` order statistics of the column. Those are
    found from ranked value counts and compared as one scalar, so journeys are
    neither sorted globally nor shuffled.
    """
    ranked = value_ranks(bounds, by)
    cuts = [F.floor(F.col("rows") * k / buckets) for k in range(1, buckets)]
    bars = ranked.agg(
        F.struct(
            *[F.max(F.when(F.col("below") <= c - 1, F.col(by))).alias(f"k{k}") for k, c in enumerate(cuts, start=1)]
        ).alias("bars")
    ).scalar()
    marked = bounds.withColumn("_bars", bars)
    above = [
        F.coalesce((F.col(by) > F.col("_bars").getField(f"k{k}")).cast("int"), F.lit(1)) for k in range(1, buckets)
    ]
    return marked.withColumn("K", sum(above, F.lit(1))).drop("_bars")


def bounds_from_status(status: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`journey_bounds` from a journey status table."""
    return status.select(
        ID,
        "total_actions",
        F.col("first_ts").alias("start_ts"),
        F.col("last_ts").alias("end_ts"),
        (micros("last_ts") - micros("first_ts")).alias("journey_us"),
        *keep,
    )


def _cut(start: str, end: str, u: Column) -> Column:
    return F.timestamp_micros(micros(start) + F.floor(u * (micros(end) - micros(start)).cast("double")).cast("long"))


def single_cutoff(bounds: DataFrame, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """One uniform cutoff per journey between its first and last event."""
    return bounds.select(ID, *keep, _cut("start_ts", "end_ts", hash_uniform(ID, 1, seed)).alias("cutoff_time"))


def k_cutoffs(bounds_k: DataFrame, seed: int = 42, keep: Sequence[str] = ()) -> DataFrame:
    """``K`` uniform cutoffs per journey with ``snapshot_id = <id>_<k>``."""
    exploded = bounds_k.select("*", F.explode(F.sequence(F.lit(1), F.col("K"))).alias("k_no"))
    return exploded.select(
        ID,
        *keep,
        "k_no",
        F.concat_ws("_", ID, F.col("k_no").cast("string")).alias("snapshot_id"),
        _cut("start_ts", "end_ts", hash_uniform(ID, "k_no", seed)).alias("cutoff_time"),
    )


def expand_snapshots(events: DataFrame, cutoffs: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Events visible at each cutoff: ids equal and ``ts <= cutoff_time``.

    Cutoffs are first matched to the active days of their journey, which drops
    days after the cutoff and gives the event join the (journey, day) key. Only
    the cutoff's own day still needs the time comparison row by row.
    """
    events = with_day(events)
    days = events.select(ID, DAY).distinct() if days is None else days.select(ID, DAY)
    routed = null_safe_join(days, cutoffs, [ID]).where(F.col(DAY) <= F.to_date("cutoff_time"))
    return null_safe_join(events, routed, [ID, DAY]).where(F.col(TS) <= F.col("cutoff_time")).drop(DAY)


def day_states(events: DataFrame, names: Sequence[str], target: str = TARGET_EVENT) -> DataFrame:
    """Mergeable states of every journey and active day, one row per value of the gap.

    A row holds how many events of the day followed their predecessor of the same day
    after ``gap_s`` whole seconds, their first and last time, the first target time and
    the counts ``n_<event>``. A day's first event has no predecessor in it; its row is
    the one marked ``opens``. A day of a journey has at most 86,400 distinct gaps, so
    the table stays small however many events one journey holds. Gap and states share
    the shuffle on (journey, day).
    """
    events = with_day(events)
    before = F.lag(TS).over(Window.partitionBy(ID, DAY).orderBy(TS))
    timed = events.withColumn("_before_ts", before).withColumns(
        {"gap_s": epoch_seconds(TS) - epoch_seconds("_before_ts"), "opens": F.col("_before_ts").isNull()}
    )
    return timed.groupBy(ID, DAY, "opens", "gap_s").agg(
        F.count("*").alias("n"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.min(F.when(F.col(NAME) == target, F.col(TS))).alias("first_target_ts"),
        *[F.count_if(F.col(NAME) == n).alias(f"n_{n}") for n in names],
    )


def days_of_states(states: DataFrame) -> DataFrame:
    """The journey-day table (:func:`spread.journey_days`) from :func:`day_states`."""
    return states.groupBy(ID, DAY).agg(
        F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.min("first_target_ts").alias("first_target_ts"),
    )


def features_at(
    events: DataFrame,
    states: DataFrame,
    days: DataFrame,
    cutoffs: DataFrame,
    names: Sequence[str],
    by: Sequence[str] = (ID,),
) -> DataFrame:
    """:func:`features.flatten_journeys` as of each cutoff, without expanding the events.

    Days before the cutoff's own come in as their states; only events of a cutoff's own
    day are compared with it one by one. Events without a time are visible at no cutoff.
    ``by`` names columns of ``cutoffs`` that tell snapshots apart, the id among them.
    ``states`` and ``days`` are tables of :func:`day_states` and :func:`days_of_states`
    of the same events.
    """
    own = F.to_date("cutoff_time")
    keys = [*by, "cutoff_time"]
    by_day = Window.partitionBy(ID).orderBy(DAY)
    linked = days.select(
        ID, DAY, "first_ts", epoch_seconds(F.lag("last_ts").over(by_day)).alias("_carry_s")
    ).where(F.col("first_ts").isNotNull())
    routed = null_safe_join(linked.drop("first_ts"), cutoffs.select(*keys), [ID]).where(F.col(DAY) <= own)
    counts = [F.col(f"`n_{n}`") for n in names]

    def first_gap(opens: Column, ts: str) -> Column:
        return F.when(opens, epoch_seconds(ts) - F.col("_carry_s")).otherwise(F.col("gap_s")).alias("gap_s")

    earlier = null_safe_join(states, routed.where(F.col(DAY) < own), [ID, DAY]).select(
        *keys, first_gap(F.col("opens"), "first_ts"), "n", "first_ts", "last_ts", *counts
    )
    visible = null_safe_join(with_day(events), routed.where(F.col(DAY) == own), [ID, DAY]).where(
        F.col(TS) <= F.col("cutoff_time")
    )
    # One snapshot sees at most one day here, so the window holds a part of a day.
    before = F.lag(TS).over(Window.partitionBy(*by, DAY).orderBy(TS))
    timed = visible.withColumn("_before_ts", before).withColumn("gap_s", epoch_seconds(TS) - epoch_seconds("_before_ts"))
    last_day = timed.select(
        *keys,
        first_gap(F.col("_before_ts").isNull(), TS),
        F.lit(1).cast("long").alias("n"),
        F.col(TS).alias("first_ts"),
        F.col(TS).alias("last_ts"),
        *[(F.col(NAME) == n).cast("long").alias(f"n_{n}") for n in names],
    )
    start, end = F.min("first_ts"), F.max("last_ts")
    return (
        earlier.unionByName(last_day)
        .groupBy(*by)
        .agg(
            start.alias("first_action_ts"),
            end.alias("last_action_ts"),
            (epoch_seconds(end) - epoch_seconds(start)).alias("journey_length_s"),
            ((epoch_seconds(F.max("cutoff_time")) - epoch_seconds(end)) / 86400).cast("int").alias("days_inactive"),
            F.sum("n").alias("total_actions"),
            (F.sum(F.col("gap_s") * F.col("n")) / F.sum(F.when(F.col("gap_s").isNotNull(), F.col("n")))).alias(
                "mean_gap_sec"
            ),
            F.percentile("gap_s", 0.5, F.col("n")).alias("median_gap_sec"),
            F.max("gap_s").alias("max_gap_sec"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{n}") for n, c in zip(names, counts)],
        )
    )


def truncate_at(events: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The single-cutoff case of :func:`expand_snapshots`."""
    return expand_snapshots(events, cutoffs.select(ID, "cutoff_time"))

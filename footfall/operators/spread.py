"""Work on ordered journeys without putting a whole journey in one task.

One journey may hold a large share of all events, so nothing here partitions a
full event table by journey id alone. Events are partitioned by journey and
calendar day. Whatever must cross a day (the previous event, running totals,
facts about the journey) is computed on a table with one row per journey and
day and joined back on that same pair. The longest journey then contributes at
most one row per day of the log to any by-journey step, and the wide event rows
move once, on the (journey, day) key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.schema import ID, NAME, ORDER, TARGET_EVENT, TS
from footfall.session import materialize

DAY = "_day"
# Rows that one task orders, about.
PART_ROWS = 100_000


def with_day(events: DataFrame) -> DataFrame:
    """Add the calendar day that splits journeys into parts.

    Events without a time share one early day, so joins on the day keep them.
    """
    if DAY in events.columns:
        return events
    return events.withColumn(DAY, F.coalesce(F.to_date(TS), F.to_date(F.lit("0001-01-01"))))


def with_fine_day(events: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """:func:`with_day` where a journey's day may itself hold more than a task can order.

    Days of more than ``part_rows`` events are cut into ranges of (time, tie), and the
    day column becomes the pair of day and range. Ranges follow the order of events, so
    whatever is carried from day to day (running counts, previous events, first
    occurrences of names) is carried from range to range in the same way. That also
    parts the events without a time, which all share one day.
    """
    events = with_day(events)
    columns = [c for c in events.columns if c != DAY]
    sizes = events.groupBy(ID, DAY).agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows).select(ID, DAY)
    heavy = materialize(sizes, "heavy-days")
    light = null_safe_join(events, heavy, [ID, DAY], "left_anti").withColumn("_part", F.lit(0))
    # A large day is spread over many tasks by the join of the few heavy days.
    large = null_safe_join(events, heavy, [ID, DAY], "left_semi")
    ranged, _ = in_range_parts(large, [ID, DAY, *order_columns(events)], part_rows=part_rows)
    every = light.unionByName(ranged)
    return every.select(*columns, F.struct(F.col(DAY).alias("day"), F.col("_part").alias("part")).alias(DAY))


def journey_days(events: DataFrame, target: str = TARGET_EVENT) -> DataFrame:
    """One row per journey and active day: events, first, last and first target time.

    Status, outcomes, bounds, cutoffs and the previous time of a day's first
    event all follow from this small table, so a flow that needs several of them
    reads the full log once for it. Flows write it to the shared folder.
    """
    return (
        with_day(events)
        .groupBy(ID, DAY)
        .agg(
            F.count("*").alias("n"),
            F.min(TS).alias("first_ts"),
            F.max(TS).alias("last_ts"),
            F.min(F.when(F.col(NAME) == target, F.col(TS))).alias("first_target_ts"),
        )
    )


def join_dimension(events: DataFrame, dim: DataFrame, key: str, slices: int = 16) -> DataFrame:
    """Left join of a table with one row per key value, such as an event name.

    A few values hold most events, so every event takes one of ``slices`` by a
    hash of its journey and time, and the dimension stands in all of them. The
    planner knows the size of a dimension that is a literal or a stored table and
    broadcasts a small one; the join of a large one stays even.
    """
    spot = F.pmod(F.xxhash64(*[c for c in (ID, TS) if c in events.columns]), F.lit(slices)).cast("int")
    spread = dim.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return events.withColumn("_slice", spot).join(spread, [key, "_slice"], "left").drop("_slice")


def null_safe_join(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on columns of equal names in which null equals null."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in key})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key])
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in key])


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Add a hash of the file and row that every row comes from.

    Unlike a number given while a job runs it is the same whenever the row is read, so
    it can deal rows to tasks that may be run again. Rows that do not come straight from
    files are written first.
    """
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return df.select("*", place)
    except AnalysisException:
        return materialize(df, "placed").select("*", place)


def in_range_parts(
    rows: DataFrame, order: Sequence, name: str = "_part", part_rows: int | None = None
) -> tuple[DataFrame, int]:
    """The rows, written once, with the number of the range of ``order`` they lie in, and
    how many ranges there are.

    Ranges are cut by a sample of the rows themselves, so values that are close
    together, such as failure probabilities or times in microseconds, are spread as
    evenly as any others, and there are the more of them the more rows there are. The
    numbers are stored with the rows: whoever reads them sees the same ones.
    """
    rows = materialize(rows, "counts")
    parts = max(1, -(-rows.count() // (part_rows or PART_ROWS)))
    if parts == 1:
        return rows.withColumn(name, F.lit(0)), parts
    return materialize(rows.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()), "ranges"), parts


def order_columns(events: DataFrame) -> list[Column]:
    return [F.col(c) for c in ORDER if c in events.columns]


def day_window(events: DataFrame):
    """Time-ordered window over one day of one journey."""
    return Window.partitionBy(ID, DAY).orderBy(*order_columns(events))


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    key: Sequence[str],
    part: Sequence[str],
    how: str = "inner",
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Join a table with one row per key to rows whose keys may be very uneven.

    ``per_key`` is first joined to the distinct (key, part) pairs of the rows, so
    the join that moves the rows themselves runs on the finer pair. Left, inner,
    semi and anti joins are supported; a null key equals a null key. ``rows`` and ``per_key`` share only the
    key columns. ``pairs`` is a ready table with one row per pair.
    """
    key, part = list(key), list(part)
    pairs = rows.select(*key, *part).distinct() if pairs is None else pairs.select(*key, *part)
    if how in ("left_semi", "left_anti"):
        return null_safe_join(rows, null_safe_join(pairs, per_key.select(*key), key, "left_semi"), key + part, how)
    return null_safe_join(rows, null_safe_join(pairs, per_key, key, how), key + part, how)


def attach_journey(
    events: DataFrame, per_journey: DataFrame, how: str = "inner", days: DataFrame | None = None
) -> DataFrame:
    """Join facts with one row per journey to the events, spread over days."""
    had_day = DAY in events.columns
    out = attach(with_day(events), per_journey, [ID], [DAY], how, days)
    return out if had_day else out.drop(DAY)


def with_previous(events: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the previous event's value of each column (``{new name: column}``).

    Inside a day this is a plain ``lag``. The first event of a day takes the last
    value of the journey's previous active day.
    """
    had_day = DAY in events.columns
    events = with_day(events)
    order = day_window(events)
    by_day = Window.partitionBy(ID).orderBy(DAY)
    sort_key = F.struct(*order_columns(events))
    carried = (
        events.groupBy(ID, DAY)
        .agg(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), sort_key).alias("_last"))
        .select(ID, DAY, F.lag("_last").over(by_day).alias("_carry"))
    )
    lagged = events.withColumns(
        {
            "_inner": F.lag(F.struct(*[F.col(c).alias(n) for n, c in columns.items()])).over(order),
        }
    )
    out = null_safe_join(lagged, carried, [ID, DAY], "left").withColumn("_prev", F.coalesce("_inner", "_carry"))
    out = out.withColumns({n: F.col("_prev").getField(n) for n in columns})
    out = out.drop("_inner", "_carry", "_prev")
    return out if had_day else out.drop(DAY)


def with_previous_ts(events: DataFrame, name: str = "prev_ts", days: DataFrame | None = None) -> DataFrame:
    """Add the previous event's time: the last time of the day before suffices.

    ``days`` is a ready :func:`journey_days` table of the same events.
    """
    had_day = DAY in events.columns
    events = with_day(events)
    by_day = Window.partitionBy(ID).orderBy(DAY)
    ends = events.groupBy(ID, DAY).agg(F.max(TS).alias("last_ts")) if days is None else days
    carried = ends.select(ID, DAY, F.lag("last_ts").over(by_day).alias("_carry_ts"))
    out = (
        null_safe_join(
            events.withColumn("_inner_ts", F.lag(TS).over(day_window(events))), carried, [ID, DAY], "left"
        )
        .withColumn(name, F.coalesce("_inner_ts", "_carry_ts"))
        .drop("_inner_ts", "_carry_ts")
    )
    return out if had_day else out.drop(DAY)


def running_totals(
    rows: DataFrame,
    totals: Mapping[str, Column],
    part: str,
    order: Sequence[Column],
    by: Sequence[str] = (),
    inclusive: bool = True,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums over a long order, computed part by part.

    ``part`` is a coarse, monotone piece of ``order`` with few distinct values
    per group (a day, a score bucket, a hash prefix). Sums inside a part run in
    parallel; the sums of all earlier parts come from a table with one row per
    part. With ``inclusive=False`` the current row is left out. ``whole`` adds
    the group's full sum of a total under another name.
    """
    by, whole = list(by), dict(whole or {})
    all_parts = Window.partitionBy(*by)
    earlier_parts = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, part)
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
        .select(
            *by,
            part,
            *[F.coalesce(F.sum(f"_sum_{n}").over(earlier_parts), F.lit(0)).alias(f"_off_{n}") for n in totals],
            *[F.sum(f"_sum_{n}").over(all_parts).alias(w) for w, n in whole.items()],
        )
    )
    inside = (
        Window.partitionBy(*by, part)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    out = rows.withColumns({f"_in_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in totals.items()})
    out = null_safe_join(out, offsets, [*by, part], "left")
    out = out.withColumns({n: F.col(f"_off_{n}") + F.col(f"_in_{n}") for n in totals})
    return out.drop(*[f"_{k}_{n}" for n in totals for k in ("in", "off")])


def with_event_number(events: DataFrame, name: str = "event_number") -> DataFrame:
    """Number the events of each journey from 1 in time order."""
    had_day = DAY in events.columns
    events = with_day(events)
    out = running_totals(events, {name: F.lit(1)}, DAY, order_columns(events), [ID])
    return out if had_day else out.drop(DAY)

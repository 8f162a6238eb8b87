"""Shaping, profiling and cleaning of an event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import is_weekday
from footfall.operators.spread import attach, null_safe_join, with_place
from footfall.schema import ID, NAME, TIE, TS

DEDUP_KEYS = (ID, TS, NAME)


def as_event_log(
    df: DataFrame,
    id: str | Column = ID,
    name: str | Column = NAME,
    ts: str | Column = TS,
    tie: str | Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Bring any event table to the canonical columns.

    ``tie`` settles equal timestamps inside a journey; without it the event name
    does, which is complete once duplicates are removed.
    """

    def col(c):
        return F.col(c) if isinstance(c, str) else c

    tie_col = F.lit(None).cast("long") if tie is None else col(tie).cast("long")
    return df.select(
        col(id).cast("string").alias(ID),
        col(name).alias(NAME),
        col(ts).cast("timestamp").alias(TS),
        tie_col.alias(TIE),
        *keep,
    )


def prune(df: DataFrame, columns: Sequence[str] = ("journey_steps_until_end", "sep")) -> DataFrame:
    """Drop columns that are redundant or reveal the future."""
    return df.drop(*columns)


def filter_events(events: DataFrame, names: Sequence[str]) -> DataFrame:
    return events.where(F.col(NAME).isin(*names))


def only_event(events: DataFrame, name: str) -> DataFrame:
    return events.where(F.col(NAME) == name)


def weekdays_only(df: DataFrame, ds: str = "ds") -> DataFrame:
    return df.where(is_weekday(ds))


def between_dates(df: DataFrame, ds: str, lo=None, hi=None, closed: tuple[bool, bool] = (True, False)) -> DataFrame:
    """Keep rows with ``lo <= ds < hi``; ``closed`` picks each end."""
    if lo is not None:
        df = df.where(F.col(ds) >= lo) if closed[0] else df.where(F.col(ds) > lo)
    if hi is not None:
        df = df.where(F.col(ds) <= hi) if closed[1] else df.where(F.col(ds) < hi)
    return df


def dedup_events(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, order: str = TIE) -> DataFrame:
    """Keep the first row of each key, by ``order``.

    An aggregate rather than a window: every task first merges its own copies,
    so a row copied millions of times reaches the shuffle as a few partial rows.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    if rest == [order]:
        out = df.groupBy(*keys).agg(F.min(order).alias(order))
    else:
        # The remaining columns break ties, so the pick never depends on row order.
        first = F.min(F.struct(order, *[c for c in rest if c != order]))
        out = df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")
    return out.select(*df.columns)


def duplicate_profile(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """Rows, repeated rows and their share on a key set."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
        (F.sum(F.col("n") - 1) / F.sum("n")).alias("share"),
    )


def duplicate_groups(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, slices: int = 64) -> DataFrame:
    """All rows whose key occurs more than once; nulls count as equal.

    Rows are dealt over ``slices`` by the file and row they come from, also where copies
    are alike in every column, and the few repeated keys stand in all slices. So a
    key that fills a large part of the log is neither counted nor returned by a
    single task.
    """
    keys = list(keys)
    placed = with_place(df, "_place")
    sliced = placed.withColumn("_slice", F.pmod("_place", F.lit(slices)).cast("int"))
    repeated = placed.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    spread = repeated.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return null_safe_join(sliced, spread, [*keys, "_slice"], "left_semi").select(*df.columns)


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, as count and percent, in one pass."""
    names = df.columns
    one = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"_null_{i}").alias("n_null"))
            for i, c in enumerate(names)
        ]
    )
    return one.select("_n", F.explode(rows).alias("r")).select(
        "r.column_name",
        "r.n_null",
        F.round(F.col("r.n_null") * 100.0 / F.col("_n"), 2).alias("pct_null"),
    )


def profile(df: DataFrame, distinct: Sequence[str] = (ID,), ts: str = TS) -> DataFrame:
    """Row count, distinct counts and time range."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in distinct],
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def approx_profile(df: DataFrame, distinct: Sequence[str] = (ID,), ts: str = TS, rsd: float = 0.02) -> DataFrame:
    """As :func:`profile` with sketched distinct counts, without a shuffle of ids."""
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.approx_count_distinct(c, rsd).alias(f"n_{c}") for c in distinct],
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def pair_count(df: DataFrame, a: str, b: str) -> DataFrame:
    """Number of distinct (a, b) pairs."""
    return df.select(a, b).distinct().agg(F.count("*").alias("n_pairs"))


def multi_map(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of ``a`` that go with more than one ``b``."""
    return df.select(a, b).distinct().groupBy(a).agg(F.count("*").alias("n_values")).where("n_values > 1")


def multi_map_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many ``a`` values have several ``b``, and their share of all pairs."""
    per_a = df.select(a, b).distinct().groupBy(a).agg(F.count("*").alias("n"))
    return per_a.agg(
        F.count_if(F.col("n") > 1).alias("n_multi"),
        F.sum("n").alias("n_pairs"),
        F.round(F.count_if(F.col("n") > 1) / F.sum("n"), 5).alias("share"),
    )


def code_dictionary(df: DataFrame, code: str, name: str) -> DataFrame:
    """The (code, name) pairs that occur."""
    return df.select(code, name).distinct()


def code_check(df: DataFrame, code: str, name: str) -> DataFrame:
    """Distinct codes, names and pairs; one-to-one when all three agree."""
    pairs = code_dictionary(df, code, name)
    return pairs.agg(
        F.count_distinct(code).alias("n_codes"),
        F.count_distinct(name).alias("n_names"),
        F.count("*").alias("n_pairs"),
    ).withColumn("one_to_one", (F.col("n_codes") == F.col("n_pairs")) & (F.col("n_names") == F.col("n_pairs")))


def restrict_to(df: DataFrame, ids: DataFrame, key: str = ID, part: str | None = None) -> DataFrame:
    """Rows whose key is in ``ids``.

    With ``part`` (for instance the day) the join also runs on that column, for
    tables in which one key may fill a large share of the rows.
    """
    ids = ids.select(key).distinct()
    return df.join(ids, key, "left_semi") if part is None else attach(df, ids, [key], [part], "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str = ID, part: str | None = None) -> DataFrame:
    """Rows whose key is not in ``ids``."""
    ids = ids.select(key).distinct()
    if part is None:
        return df.join(ids, key, "left_anti")
    return attach(df, ids, [key], [part], "left_anti")


def top_k(df: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows with the largest value; ``ties`` settle equal ones."""
    return df.orderBy(F.desc(column), *[F.asc(t) for t in ties]).limit(k)


def closest_to(df: DataFrame, column: str, target: float, *ties: str) -> DataFrame:
    """The row whose value is nearest to ``target``."""
    return df.orderBy(F.abs(F.col(column) - F.lit(float(target))), *[F.asc(t) for t in ties]).limit(1)


def largest_moves(df: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` rows with the largest absolute value."""
    return df.orderBy(F.desc(F.abs(F.col(column))), *[F.asc(t) for t in ties]).limit(k)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]

"""Journey and snapshot feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.times import days_between, epoch_seconds, micros
from footfall.operators.quantiles import quantiles
from footfall.operators.spread import order_columns, with_event_number, with_previous_ts
from footfall.schema import FEATURE_EVENTS, ID, LEAKY_COLUMNS, NAME, TS


def with_gaps(events: DataFrame, name: str = "gap_s", days: DataFrame | None = None) -> DataFrame:
    """Whole seconds since the previous event of the journey, null for the first."""
    timed = with_previous_ts(events, "_prev_ts", days)
    return timed.withColumn(name, epoch_seconds(TS) - epoch_seconds("_prev_ts")).drop("_prev_ts")


def count_columns(names: Sequence[str], prefix: str = "n_") -> list[Column]:
    """One conditional count per event name; absent events give 0."""
    return [F.count_if(F.col(NAME) == n).alias(f"{prefix}{n}") for n in names]


def event_counts_wide(events: DataFrame, names: Sequence[str], by: Sequence[str] = (ID,)) -> DataFrame:
    """Wide ``n_<event>`` counts for a given list of events."""
    return events.groupBy(*by).agg(*count_columns(names))


def flatten_journeys(
    events: DataFrame,
    names: Sequence[str],
    cutoff: str | Column = "cutoff_time",
    by: Sequence[str] = (ID,),
) -> DataFrame:
    """Time, gap and count features, one row per journey or snapshot.

    All features come from one aggregation. The median keeps the distinct gaps
    of a group with their counts; gaps are whole seconds that add up to the
    length of the journey, so a journey of two years has at most some ten
    thousand distinct ones, however many events it holds.
    """
    if "gap_s" not in events.columns:
        events = with_gaps(events)
    cut = F.max(cutoff)
    wide = events.groupBy(*by).agg(
        F.min(TS).alias("first_action_ts"),
        F.max(TS).alias("last_action_ts"),
        (epoch_seconds(F.max(TS)) - epoch_seconds(F.min(TS))).alias("journey_length_s"),
        ((epoch_seconds(cut) - epoch_seconds(F.max(TS))) / 86400).cast("int").alias("days_inactive"),
        F.count("*").alias("total_actions"),
        F.avg("gap_s").alias("mean_gap_sec"),
        F.percentile("gap_s", 0.5).alias("median_gap_sec"),
        F.max("gap_s").alias("max_gap_sec"),
        *count_columns(names),
    )
    return wide


def first_last(events: DataFrame) -> DataFrame:
    """First and last event of each journey with count and duration."""
    order = F.struct(*order_columns(events))
    return events.groupBy(ID).agg(
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.min_by(NAME, order).alias("first_event_name"),
        F.max_by(NAME, order).alias("last_event_name"),
        F.count("*").alias("n_events"),
    )


def per_event_name(events: DataFrame, by: Sequence[str] = (ID,)) -> DataFrame:
    """Counts, time range and latest position per journey and event name.

    At most one row per name of the vocabulary and journey, which is what the
    feature builders reduce instead of the events.
    """
    return events.groupBy(*by, NAME).agg(
        F.count("*").alias("n"),
        F.min(TS).alias("first_ts"),
        F.max(TS).alias("last_ts"),
        F.max(F.struct(*order_columns(events))).alias("last_pos"),
    )


def baseline_features(
    events: DataFrame, names: Sequence[str] = FEATURE_EVENTS, by: Sequence[str] = (ID,)
) -> DataFrame:
    """Counts, distinct names, duration, last-event flags and per-event counts.

    ``by`` may carry facts of the journey, such as its label, along with the id.
    """
    per = per_event_name(events, by).groupBy(*by).agg(
        F.sum("n").alias("n_events"),
        F.count("*").alias("n_unique_events"),
        days_between(F.max("last_ts"), F.min("first_ts")).alias("journey_duration_days"),
        F.max_by(NAME, "last_pos").alias("_last"),
        *[F.sum(F.when(F.col(NAME) == n, F.col("n")).otherwise(0)).alias(f"n_{n}") for n in names],
    )
    return per.select(
        *by,
        "n_events",
        "n_unique_events",
        "journey_duration_days",
        *[(F.col("_last") == n).cast("int").alias(f"last_is_{n}") for n in names],
        *[F.col(f"`n_{n}`") for n in names],
    )


def list_features(events: DataFrame, last_of: Sequence[str], counts_of: Sequence[str]) -> DataFrame:
    """Length, distinct names, duration, chosen last-event flags and counts.

    The values a list-based journey table yields, without building the lists.
    ``n_unique_events`` doubles as the rebuilt step counter of the journey.
    """
    per = per_event_name(events).groupBy(ID).agg(
        F.sum("n").alias("n_events"),
        F.count("*").alias("n_unique_events"),
        days_between(F.max("last_ts"), F.min("first_ts")).alias("journey_duration_days"),
        F.max_by(NAME, "last_pos").alias("last_event_name"),
        *[F.sum(F.when(F.col(NAME) == n, F.col("n")).otherwise(0)).alias(f"n_{n}") for n in counts_of],
    )
    return per.select(
        "*", *[(F.col("last_event_name") == n).cast("int").alias(f"last_event_is_{n}") for n in last_of]
    )


def journey_lists(events: DataFrame, page_size: int = 4096) -> DataFrame:
    """Each journey as ordered lists of names and times, in pages.

    A page holds at most ``page_size`` events, so no row grows with the longest
    journey; ordinary journeys are one page. Pages are numbered from 0.
    """
    order = order_columns(events)
    numbered = with_event_number(events, "_pos").withColumn("page", ((F.col("_pos") - 1) / page_size).cast("int"))
    item = F.struct(*order, F.col(NAME).alias("_name"))
    return (
        numbered.groupBy(ID, "page")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(
            ID,
            "page",
            F.size("_items").alias("n_events"),
            F.transform("_items", lambda x: x["_name"]).alias("event_names"),
            F.transform("_items", lambda x: x[TS]).alias("event_timestamps"),
        )
    )


def list_row_features(lists: DataFrame, last_of: str, count_of: str) -> DataFrame:
    """Array functions per journey over all its pages: length, distinct, last, count, contains.

    Pages are reduced first; what is gathered per journey is its set of distinct
    names per page.
    """
    names = F.col("event_names")
    pages = lists.select(
        ID,
        "page",
        F.size(names).alias("n"),
        F.array_sort(F.array_distinct(names)).alias("distinct_names"),
        (F.element_at(names, -1) == last_of).cast("int").alias("last"),
        F.size(F.filter(names, lambda x: x == count_of)).alias("of"),
    )
    return pages.groupBy(ID).agg(
        F.sum("n").alias("n_events"),
        F.size(F.array_distinct(F.flatten(F.collect_set("distinct_names")))).alias("n_unique_events"),
        F.max_by("last", "page").alias("last_is"),
        F.sum("of").alias("n_of"),
        (F.sum("of") > 0).alias("has"),
    )


def drop_leaky(df: DataFrame, names: Sequence[str] = LEAKY_COLUMNS) -> DataFrame:
    """Drop columns that reveal the outcome; names that are absent are ignored."""
    return df.drop(*names)


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Exactly the given columns in order: missing ones filled, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(fill).alias(c) for c in columns])


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns) if columns else None)


def fill_median(df: DataFrame, columns: Sequence[str], reference: DataFrame) -> DataFrame:
    """Replace nulls by the column's median in ``reference``, or 0 if it has none.

    The columns are stacked so that one pass finds all medians.
    """
    cells = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]
    stacked = reference.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    found = quantiles(stacked, "value", {"median": 0.5}, ["measure"])
    medians = found.agg(F.map_from_entries(F.collect_list(F.struct("measure", "median")))).scalar()
    filled = df.withColumn("_medians", medians)
    return filled.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.try_element_at("_medians", F.lit(c)), F.lit(0.0))
            for c in columns
        }
    ).drop("_medians")


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Doubles from any column: times become epoch seconds, bad text becomes 0."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def number(c: str) -> Column:
        if isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType, T.DateType)):
            value = micros(c) / F.lit(1e6)
        elif isinstance(kinds[c], T.BooleanType):
            value = F.col(f"`{c}`").cast("int").cast("double")
        else:
            value = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns({c: F.coalesce(number(c), F.lit(0.0)) for c in columns})


def add_rates(df: DataFrame, checkout="n_begin_checkout", cart="n_add_to_cart", browse="n_browse_products", total="n_events") -> DataFrame:
    """Checkout and cart share of all events, and carts per product view."""
    n = F.greatest(F.col(total), F.lit(1))
    return df.withColumns(
        {
            "checkout_rate": F.col(checkout) / n,
            "cart_rate": F.col(cart) / n,
            "browse_to_cart": F.col(cart) / (F.col(browse) + 1),
        }
    )


def with_label(df: DataFrame, column: str = "final_outcome", positive: str = "success", name: str = "label") -> DataFrame:
    """1 for the positive outcome, else 0."""
    return df.withColumn(name, F.when(F.col(column) == positive, 1).otherwise(0))


def with_constant_outcome(df: DataFrame, outcome: str = "incomplete") -> DataFrame:
    """Outcome column for open journeys; values already there are kept."""
    if "final_outcome" in df.columns:
        return df.withColumn("final_outcome", F.coalesce("final_outcome", F.lit(outcome)))
    return df.withColumn("final_outcome", F.lit(outcome))


def standardize(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Z-scores with the training mean and deviation; a zero or missing deviation counts as 1."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("stats")
    ).scalar()

    def scaled(df: DataFrame) -> DataFrame:
        df = df.withColumn("_stats", stats)
        cells = {}
        for c in columns:
            sd = F.col("_stats").getField(f"s_{c}")
            sd = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
            cells[c] = (F.col(c) - F.col("_stats").getField(f"m_{c}")) / sd
        return df.withColumns(cells).drop("_stats")

    return scaled(train), scaled(test)

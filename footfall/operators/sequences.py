"""Event sequences for sequence models: long tables and padded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.scalars import pad_left, pad_right
from footfall.functions.times import epoch_seconds, hours_between
from footfall.operators.outcomes import restrict_events
from footfall.operators.snapshots import expand_snapshots
from footfall.operators.spread import DAY, join_dimension, null_safe_join, order_columns, with_day
from footfall.schema import ID, NAME, TS
from footfall.session import materialize


def build_vocab(*logs: DataFrame) -> DataFrame:
    """Distinct event names of all logs, sorted and numbered from 1; 0 is padding.

    The numbering window sees the vocabulary only, some thirty names.
    """
    names = logs[0].select(NAME).distinct()
    for log in logs[1:]:
        names = names.union(log.select(NAME).distinct())
    return names.where(F.col(NAME).isNotNull()).distinct().select(
        NAME, F.row_number().over(Window.orderBy(NAME)).alias("event_idx")
    )


def vocab_json(vocab: DataFrame) -> DataFrame:
    """The vocabulary as one JSON object."""
    entries = F.array_sort(F.collect_list(F.struct(NAME, "event_idx")))
    return vocab.agg(F.to_json(F.map_from_entries(entries)).alias("vocab"))


def vocab_from_json(df: DataFrame, column: str = "vocab") -> DataFrame:
    """Back from JSON to one row per name."""
    return df.select(F.explode(F.from_json(column, "map<string,int>")).alias(NAME, "event_idx"))


def encode_events(events: DataFrame, vocab: DataFrame, unknown: int | None = 0) -> DataFrame:
    """Add ``event_idx``; names outside the vocabulary get ``unknown``.

    The vocabulary is written first, so that the planner knows its size.
    """
    out = join_dimension(events, materialize(vocab, "vocabulary"), NAME)
    return out if unknown is None else out.withColumn("event_idx", F.coalesce("event_idx", F.lit(unknown)))


def _newest_first(events: DataFrame, by: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*[c.desc() for c in order_columns(events)])


def last_n_events(events: DataFrame, n: int, by: Sequence[str] = (ID,), position: str = "seq_idx") -> DataFrame:
    """The last ``n`` events per group in time order, numbered from 1.

    The row-number filter is applied inside every map task before the shuffle,
    so a task sends at most ``n`` rows per journey, however long that is.
    """
    newest = events.withColumn("_back", F.row_number().over(_newest_first(events, by))).where(F.col("_back") <= n)
    ordered = Window.partitionBy(*by).orderBy(*order_columns(events))
    return newest.withColumn(position, F.row_number().over(ordered)).drop("_back")


def sequence_long(
    events: DataFrame,
    vocab: DataFrame,
    max_len: int = 100,
    first_gap_zero: bool = False,
    by: Sequence[str] = (ID,),
) -> DataFrame:
    """``id, seq_idx, event_idx, log_gap`` for the last ``max_len`` events.

    One event more than needed is kept until the gaps are known, so the first
    kept event still shows its true gap; a journey's first event has gap 0.
    """
    kept = last_n_events(events, max_len + 1, by, "_no")
    ordered = Window.partitionBy(*by).orderBy("_no")
    size = F.max("_no").over(Window.partitionBy(*by))
    gap = epoch_seconds(TS) - F.lag(epoch_seconds(TS)).over(ordered)
    rows = kept.withColumns({"_gap": F.coalesce(gap, F.lit(0)), "_skip": F.greatest(size - max_len, F.lit(0))})
    rows = rows.where(F.col("_no") > F.col("_skip")).withColumn("seq_idx", F.col("_no") - F.col("_skip"))
    gap_s = F.when(F.col("seq_idx") == 1, F.lit(0)).otherwise(F.col("_gap")) if first_gap_zero else F.col("_gap")
    return encode_events(rows.withColumn("log_gap", F.log1p(gap_s.cast("double"))), vocab, None).select(
        *by, F.col("seq_idx").cast("int"), "event_idx", "log_gap"
    )


def train_sequences(events: DataFrame, cutoffs: DataFrame, vocab: DataFrame, outcomes: DataFrame, max_len: int = 100) -> DataFrame:
    """Labelled sequences of closed journeys, each cut at its cutoff."""
    labelled = outcomes.where(F.col("final_outcome") != "incomplete").select(ID, "final_outcome")
    closed = null_safe_join(cutoffs.select(ID, "cutoff_time"), labelled.select(ID), [ID], "left_semi")
    return null_safe_join(sequence_long(expand_snapshots(events, closed), vocab, max_len), labelled, [ID])


def open_sequences(events: DataFrame, vocab: DataFrame, outcomes: DataFrame, max_len: int = 100) -> DataFrame:
    """Sequences of open journeys with everything seen so far."""
    open_ids = outcomes.where(F.col("final_outcome") == "incomplete").select(ID)
    return sequence_long(restrict_events(events, open_ids), vocab, max_len)


def sequence_events(snapshots: DataFrame, events: DataFrame, max_len: int = 80) -> DataFrame:
    """Last events of every snapshot up to the snapshot's own last action.

    Counts per journey and day tell which days can hold a snapshot's last events;
    only those are expanded. The cutoff's own day counts as empty, since part of
    it lies behind the cutoff.
    """
    cuts = snapshots.select(ID, "snapshot_id", F.col("last_action_ts").alias("cutoff_time"))
    days = with_day(events).groupBy(ID, DAY).agg(F.count("*").alias("_n"))
    known = null_safe_join(days, cuts, [ID]).where(F.col(DAY) <= F.to_date("cutoff_time"))
    full = F.when(F.col(DAY) < F.to_date("cutoff_time"), F.col("_n")).otherwise(0)
    later = Window.partitionBy("snapshot_id").orderBy(F.desc(DAY)).rowsBetween(Window.unboundedPreceding, -1)
    needed = known.where("_n > 0").withColumn("_later", F.coalesce(F.sum(full).over(later), F.lit(0)))
    routed = needed.where(F.col("_later") < max_len).drop("_n", "_later")
    visible = null_safe_join(with_day(events), routed, [ID, DAY]).where(F.col(TS) <= F.col("cutoff_time")).drop(DAY)
    return last_n_events(visible, max_len, ["snapshot_id"])


def sequence_channels(rows: DataFrame) -> DataFrame:
    """``log_delta_h`` and ``log_to_cutoff_h`` of kept rows, both from 0 up."""
    ordered = Window.partitionBy("snapshot_id").orderBy("seq_idx")
    delta = F.coalesce(hours_between(TS, F.lag(TS).over(ordered)), F.lit(0.0))
    return rows.withColumns(
        {
            "log_delta_h": F.log1p(F.greatest(delta, F.lit(0.0))),
            "log_to_cutoff_h": F.log1p(F.greatest(hours_between("cutoff_time", TS), F.lit(0.0))),
        }
    )


def sequence_arrays(
    snapshots: DataFrame,
    events: DataFrame,
    vocab: DataFrame,
    max_len: int = 80,
    side: str = "right",
) -> DataFrame:
    """One row per snapshot: padded ids, two padded channels, true length, label.

    Arrays hold at most ``max_len`` entries. Snapshots without events keep zeros
    and length 1. ``side`` names the end that is filled.
    """
    rows = encode_events(sequence_channels(sequence_events(snapshots, events, max_len)), vocab)
    items = F.array_sort(F.collect_list(F.struct("seq_idx", "event_idx", "log_delta_h", "log_to_cutoff_h")))
    grouped = rows.groupBy("snapshot_id").agg(items.alias("_items"))
    pad = {"left": pad_left, "right": pad_right}[side]

    def channel(field: str, kind: str, zero) -> Column:
        xs = F.transform(F.coalesce("_items", F.array().cast(grouped.schema["_items"].dataType)), lambda x: x[field].cast(kind))
        return pad(xs, max_len, F.lit(zero).cast(kind))

    return snapshots.join(grouped, "snapshot_id", "left").select(
        "snapshot_id",
        ID,
        channel("event_idx", "int", 0).alias("event_ids"),
        channel("log_delta_h", "float", 0.0).alias("delta"),
        channel("log_to_cutoff_h", "float", 0.0).alias("to_cutoff"),
        F.greatest(F.coalesce(F.size("_items"), F.lit(0)), F.lit(1)).alias("length"),
        F.when(F.col("final_outcome") == "success", 1).otherwise(0).alias("label"),
    )

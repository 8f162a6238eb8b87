"""Duplicate removal and journey states while the log arrives in pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from footfall.operators.clean import DEDUP_KEYS
from footfall.schema import ID, INACTIVITY_DAYS, NAME, TARGET_EVENT, TS

CHANGES = (
    "id string, n_events long, first_us long, last_us long, first_target_us long, final_outcome string, version long"
)
# One array element per journey of a group; ``waiting`` marks those that silence may still fail.
STATE = (
    "ids array<string>, n_events array<long>, first_us array<long>, last_us array<long>, first_target_us array<long>, "
    "version array<long>, waiting array<boolean>"
)
FIELDS = ["id", "n_events", "first_us", "last_us", "first_target_us", "version", "waiting"]
DAY_MS = 86_400_000
# Stands for no target yet, since columns with nulls would pass through floats.
NEVER = 2**62


def deduplicated(events: DataFrame, keys: Sequence[str] = DEDUP_KEYS, delay: str = "0 seconds") -> DataFrame:
    """The first arrival of each key; later copies are dropped.

    The time is part of the key, so a key is forgotten once the watermark, ``delay``
    behind the latest time seen, has passed it: state is bounded by the events of that
    stretch. Events behind the watermark are dropped. Events without a time never leave
    the state and are therefore refused here.
    """
    if TS not in keys:
        raise ValueError("the time must be part of the key, or state would never be dropped")
    return events.where(F.col(TS).isNotNull()).withWatermark(TS, delay).dropDuplicates(list(keys))


def journey_changes(
    events: DataFrame,
    target: str = TARGET_EVENT,
    inactivity_days: int = INACTIVITY_DAYS,
    delay: str = "0 seconds",
    groups: int = 256,
) -> DataFrame:
    """A row whenever a journey changes: new events, the target, or too long a silence.

    ``final_outcome`` is ``success`` from the first target event on, ``failure`` once the
    watermark has passed the last event by the inactivity limit, else ``incomplete``.
    Timers raise the latter without any new event. A journey that returns after its
    failure is open again. ``version`` grows with every change of a journey.
    State is a few numbers per journey; the events themselves are not kept. Journeys share
    one of ``groups`` state rows by a hash of their id, so Python is called once per group
    and micro-batch instead of once per journey; take more groups where one would hold
    more journeys than a task can handle at once.
    """

    def step(key, batches, state: GroupState):
        import pandas as pd

        now = state.getCurrentWatermarkMs()
        parts = [pd.DataFrame(dict(zip(FIELDS, state.get)))] if state.exists else []
        for part in batches:
            if not len(part):
                continue  # a timer
            new = part.groupby("id", dropna=False, sort=False).agg(
                n_events=("us", "size"), first_us=("us", "min"), last_us=("us", "max"), first_target_us=("hit_us", "min")
            )
            parts.append(new.reset_index().assign(version=0, waiting=False, fresh=True))
        every = pd.concat([p if "fresh" in p else p.assign(fresh=False) for p in parts], ignore_index=True)
        merged = every.groupby("id", dropna=False, sort=False, as_index=False).agg(
            {
                "n_events": "sum", "first_us": "min", "last_us": "max", "first_target_us": "min", "version": "max",
                "waiting": "max", "fresh": "max",
            }
        )
        merged["id"] = merged["id"].astype(object).where(merged["id"].notna(), None)
        fresh, silent = merged["fresh"].astype(bool), merged["first_target_us"] == NEVER
        # A timer fires when the watermark is beyond it, so at the limit itself.
        due = merged["last_us"] // 1000 + inactivity_days * DAY_MS - 1
        raised = ~fresh & merged["waiting"].astype(bool) & (due < now)
        failed = raised | (fresh & silent & (due <= now))
        changed = fresh | raised
        merged["version"] += changed
        merged["waiting"] = silent & ~failed & (fresh | merged["waiting"].astype(bool))
        state.update(tuple(merged[f].tolist() for f in FIELDS))
        if merged["waiting"].any():
            state.setTimeoutTimestamp(int(due[merged["waiting"]].min()))
        out = merged[changed].drop(columns=["waiting", "fresh"])
        out["final_outcome"] = "success"
        out.loc[silent[changed], "final_outcome"] = "incomplete"
        out.loc[failed[changed], "final_outcome"] = "failure"
        yield out[[*FIELDS[:5], "final_outcome", "version"]]

    us = F.unix_micros(TS)
    slim = events.where(F.col(TS).isNotNull()).withWatermark(TS, delay).select(
        F.pmod(F.xxhash64(ID), F.lit(groups)).alias("_group"),
        ID,
        TS,
        us.alias("us"),
        F.when(F.col(NAME) == target, us).otherwise(F.lit(NEVER)).alias("hit_us"),
    )
    changes = slim.groupBy("_group").applyInPandasWithState(
        step, CHANGES, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )
    hit = F.col("first_target_us")
    return changes.withColumn("first_target_us", F.when(hit < NEVER, hit))


def run_to_folder(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write every micro-batch to a folder of its own, then stop once all files are read.

    A batch that is run again after a failure replaces its own folder, so nothing is
    written twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )


def written_rows(rows: DataFrame, path: str) -> DataFrame:
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def latest_states(changes: DataFrame, path: str) -> DataFrame:
    """The last change of every journey."""
    found = written_rows(changes, path)
    rest = [c for c in found.columns if c != ID]
    return found.groupBy(ID).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(ID, "s.*")

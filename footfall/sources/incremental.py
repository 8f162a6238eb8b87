"""Derived tables that grow by the days they do not cover yet.

A table is kept as mergeable partial states per day: counts, sums, extremes, sketches.
Extending it reads only the days from the first uncovered one on, writes their states
to a folder of their own and then switches one small pointer file, which names the
folders that are alive and the days each covers. Readers see the version before or the
one after, whole; a failed extension leaves a folder that no pointer names. Folders are
put together when there are many of them, so reading stays cheap.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FOLDERS = 32


@dataclass(frozen=True)
class State:
    """A partial state: its aggregate over rows, over states, and what it tells."""

    of_rows: Column
    of_states: Callable[[str], Column]
    value: Callable[[str], Column] = F.col


def counted(condition: Column | None = None) -> State:
    return State(F.count("*") if condition is None else F.count_if(condition), F.sum)


def summed(c) -> State:
    return State(F.sum(c), F.sum)


def least(c) -> State:
    return State(F.min(c), F.min)


def greatest(c) -> State:
    return State(F.max(c), F.max)


def distinct_estimate(c) -> State:
    """Approximate number of distinct values; the sketches of days merge without loss."""
    return State(F.hll_sketch_agg(c), F.hll_union_agg, F.hll_sketch_estimate)


class DailyStates:
    """Partial states per day under ``path``.

    ``day`` names a date column of the source; ``states`` the columns kept per day (and
    per value of the ``by`` columns).
    """

    def __init__(self, spark: SparkSession, path: str, day: str, states: Mapping[str, State], by: tuple[str, ...] = ()):
        self.spark, self.path, self.day, self.states, self.by = spark, path.rstrip("/"), day, dict(states), tuple(by)

    # The pointer is one small file; everything else goes through Spark.

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, conf, where, where.getFileSystem(conf)

    def folders(self) -> list[dict]:
        """The folders that are alive: ``path``, first and last day."""
        jvm, _, _, fs = self._files()
        pointer = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current.json")
        if not fs.exists(pointer):
            return []
        stream = fs.open(pointer)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"]
        finally:
            stream.close()

    def _switch(self, folders: list[dict]) -> None:
        jvm, conf, where, fs = self._files()
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_draft-{uuid.uuid4().hex}.json")
        fs.mkdirs(where)
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"folders": folders}), "utf-8"))
        stream.close()
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.path}/_current.json"), overwrite)

    def covered(self) -> date | None:
        """The last day that is covered."""
        return max((date.fromisoformat(f["last"]) for f in self.folders()), default=None)

    def uncovered(self, source: Callable[[date | None], DataFrame], again: int = 0) -> tuple[DataFrame, date | None]:
        """The source's rows from the first uncovered day on, and that day."""
        last = self.covered()
        first = None if last is None else last + timedelta(days=1 - again)
        rows = source(first)
        return (rows if first is None else rows.where(F.col(self.day) >= F.lit(first))), first

    def extend(self, source: Callable[[date | None], DataFrame], upto: date | None = None, again: int = 0) -> bool:
        """Add the days after the last covered one, up to ``upto``; true if there were any.

        ``source`` gets the first day wanted (None: all) and should filter its scan by it,
        so that older files and row groups are not read. The last ``again`` covered days
        are read and replaced, for sources whose recent days still change. Rows without a
        day take no part.
        """
        rows, first = self.uncovered(source, again)
        rows = rows.where(F.col(self.day).isNotNull())
        if upto is not None:
            rows = rows.where(F.col(self.day) <= F.lit(upto))
        states = rows.groupBy(self.day, *self.by).agg(*[s.of_rows.alias(n) for n, s in self.states.items()])
        added = self._written(states)
        if added is None:
            return False
        keep = self.folders()
        if first is not None and again:
            # Replaced days leave the folders that held them.
            kept = self._read(keep).where(F.col(self.day) < F.lit(first)) if keep else None
            rest = None if kept is None else self._written(self._merged(kept))
            keep = [rest] if rest else []
        elif len(keep) >= MOST_FOLDERS:
            keep = [self._written(self._merged(self._read(keep)))]
        self._switch([*keep, added])
        return True

    def _written(self, states: DataFrame) -> dict | None:
        folder = f"{self.path}/states-{uuid.uuid4().hex}"
        states.write.parquet(folder)
        first, last = self.spark.read.schema(states.schema).parquet(folder).agg(F.min(self.day), F.max(self.day)).first()
        return None if first is None else {"path": folder, "first": first.isoformat(), "last": last.isoformat()}

    def _read(self, folders: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f["path"] for f in folders])

    def _merged(self, states: DataFrame, *keys: str) -> DataFrame:
        keys = keys or (self.day, *self.by)
        kinds = {f.name: f.dataType for f in states.schema.fields}
        # Sums of sums would have a wider type each time.
        return states.groupBy(*keys).agg(*[s.of_states(n).cast(kinds[n]).alias(n) for n, s in self.states.items()])

    def table(self, lo: date | None = None, hi: date | None = None) -> DataFrame:
        """One row per day (and ``by``); folders outside the wanted days are not opened."""
        return self._told(self._within(lo, hi), self.day, *self.by)

    def totals(self, *keys: Column, lo: date | None = None, hi: date | None = None) -> DataFrame:
        """States merged over days: per key, such as a month, or in total."""
        named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
        states = self._within(lo, hi)
        grouped = states.select("*", *named).groupBy(*[f"_k{i}" for i in range(len(keys))])
        return grouped.agg(*[s.of_states(n).alias(n) for n, s in self.states.items()]).select(
            *[F.col(f"_k{i}") for i in range(len(keys))], *[s.value(n).alias(n) for n, s in self.states.items()]
        )

    def _within(self, lo, hi) -> DataFrame:
        alive = self.folders()
        if not alive:
            raise ValueError(f"nothing was ever added to {self.path}")
        wanted = [
            f
            for f in alive
            if (lo is None or f["last"] >= lo.isoformat()) and (hi is None or f["first"] <= hi.isoformat())
        ]
        states = self._read(wanted or alive[:1])
        if lo is not None:
            states = states.where(F.col(self.day) >= F.lit(lo))
        return states if hi is None else states.where(F.col(self.day) <= F.lit(hi))

    def _told(self, states: DataFrame, *keys: str) -> DataFrame:
        return self._merged(states, *keys).select(*keys, *[s.value(n).alias(n) for n, s in self.states.items()])

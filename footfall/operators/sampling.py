"""Samples, splits and folds drawn from value hashes.

Every draw is a function of the row key and a seed. Samples of an exact size
find the hash of the last row to keep and then filter, so the rows themselves
are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.scalars import hash_number, hash_uniform
from footfall.operators.spread import null_safe_join, running_totals
from footfall.schema import FAILURES_PER_SUCCESS, ID

_PREFIX_STEP = 1 << 16


def sample_journeys(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of a fraction of the journeys."""
    return df.where(hash_uniform(ID, seed) < fraction)


def sample_rows(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """A fraction of the rows, chosen by a row key."""
    return df.where(hash_uniform(key, seed) < fraction)


def class_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_rows"))


def _per_class(table: DataFrame, by: str, value: Column) -> Column:
    """Look up a value of a table with one row per class, as a scalar map.

    ``by`` is a class column with a handful of values. Rows are compared where
    they are, without a join on a column that only has two or three values.
    """
    entries = table.agg(F.map_from_entries(F.collect_list(F.struct(_class_key(by).alias("k"), value.alias("v"))))).scalar()
    return F.try_element_at(entries, _class_key(by))


def _class_key(by: str) -> Column:
    """The class as text; null is a class of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("null"))


def hash_bars(df: DataFrame, quota: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """Per class the (hash, key) of the last row within its quota.

    ``quota`` holds ``by, n_take``. A count per 16-bit hash prefix finds the
    prefix the quota ends in; only the rows of that prefix are ordered.
    """
    keyed = df.select(F.col(by), F.col(key), hash_number(key, seed).alias("_h")).withColumn(
        "_prefix", F.floor(F.col("_h") / _PREFIX_STEP).cast("int")
    )
    earlier = Window.partitionBy(by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        keyed.groupBy(by, "_prefix")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("n_take", _per_class(quota, by, F.col("n_take")))
        .where(F.col("_before") < F.col("n_take"))
        .groupBy(by)
        .agg(F.max(F.struct("_prefix", (F.col("n_take") - F.col("_before")).alias("_left"))).alias("_edge"))
    )
    within = Window.partitionBy(by).orderBy("_h", key)
    return (
        keyed.withColumn("_edge", _per_class(edges, by, F.col("_edge")))
        .where(F.col("_prefix") == F.col("_edge._prefix"))
        .withColumn("_rn", F.row_number().over(within))
        .where(F.col("_rn") <= F.col("_edge._left"))
        .groupBy(by)
        .agg(F.max(F.struct("_h", key)).alias("_bar"))
    )


def within_quota(df: DataFrame, quota: DataFrame, by: str, key: str, seed: int) -> Column:
    """True for rows up to their class's last kept (hash, key)."""
    bar = _per_class(hash_bars(df, quota, by, key, seed), by, F.col("_bar"))
    row = F.struct(hash_number(key, seed).alias("_h"), F.col(key))
    return F.coalesce(row <= bar, F.lit(False))


def take_quota(df: DataFrame, quota: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n_take`` rows per class (or the whole class), lowest hashes first."""
    return df.where(within_quota(df, quota, by, key, seed))


def balance_quota(df: DataFrame, by: str, max_rows: int, equal: bool = True) -> DataFrame:
    """Rows to take per class: as many of each, or the same share of each."""
    # One row per class, so the window over all classes is a handful of rows.
    every = Window.partitionBy()
    if equal:
        share = F.floor(F.lit(max_rows) / F.count("*").over(every))
        take = F.least(share, F.min("n_rows").over(every))
    else:
        total = F.sum("n_rows").over(every)
        take = F.when(total > max_rows, F.floor(F.col("n_rows") * F.lit(max_rows) / total)).otherwise(F.col("n_rows"))
    return class_sizes(df, by).select(by, take.cast("long").alias("n_take"))


def balance_classes(
    df: DataFrame, by: str, max_rows: int, key: str = ID, seed: int = 42, equal: bool = True
) -> DataFrame:
    """At most ``max_rows`` rows: equally many of each class, or with ``equal=False``
    the same share of each, which is all of a smaller table."""
    return take_quota(df, balance_quota(df, by, max_rows, equal), by, key, seed)


def downsample_quota(df: DataFrame, ratio: int = FAILURES_PER_SUCCESS, max_rows: int | None = None) -> DataFrame:
    sizes = df.groupBy().agg(
        F.count_if(F.col("final_outcome") == "failure").alias("n_fail"),
        F.count_if(F.col("final_outcome") == "success").alias("n_succ"),
    )
    sizes = sizes.withColumn("goal", F.least(F.floor(F.col("n_fail") / ratio), F.col("n_succ")))
    if max_rows is None:
        takes = {"success": F.col("goal"), "failure": F.col("n_fail")}
    else:
        share = F.col("goal") / (F.col("n_fail") + F.col("goal"))
        wanted = F.greatest(F.lit(1), F.bround(share * max_rows).cast("long"))
        takes = {
            "success": F.least(wanted, F.col("n_succ")),
            "failure": F.least(F.lit(max_rows) - wanted, F.col("n_fail")),
        }
    rows = F.array(
        *[F.struct(F.lit(k).alias("final_outcome"), v.cast("long").alias("n_take")) for k, v in takes.items()]
    )
    return sizes.select(F.explode(rows).alias("r")).select("r.*")


def downsample_success(
    df: DataFrame,
    key: str = "snapshot_id",
    ratio: int = FAILURES_PER_SUCCESS,
    max_rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """One success per ``ratio`` failures; ``max_rows`` shrinks both at that share."""
    return take_quota(df, downsample_quota(df, ratio, max_rows), "final_outcome", key, seed)


def stratified_fraction(df: DataFrame, by: str, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """The fraction of each class, at least one row."""
    quota = class_sizes(df, by).select(
        by, F.greatest(F.lit(1), F.floor(F.col("n_rows") * F.lit(fraction))).cast("long").alias("n_take")
    )
    return take_quota(df, quota, by, key, seed)


def stratified_split(df: DataFrame, label: str, holdout: float = 0.25, key: str = ID, seed: int = 42) -> DataFrame:
    """Add ``is_valid``: the holdout share of each class."""
    quota = class_sizes(df, label).select(label, F.round(F.col("n_rows") * F.lit(holdout)).cast("long").alias("n_take"))
    return df.withColumn("is_valid", within_quota(df, quota, label, key, seed))


def group_folds(df: DataFrame, label: str, k: int = 5, key: str = ID, seed: int = 42) -> DataFrame:
    """``key, fold``: keys dealt to ``k`` folds in hash order within each class.

    The running number comes from counts per hash prefix plus a rank inside the
    prefix, so no class is ordered by one task. All rows of a key share its fold.
    """
    keys = df.groupBy(key).agg(F.max(label).alias(label))
    keys = keys.withColumn("_h", hash_number(key, seed)).withColumn(
        "_prefix", F.floor(F.col("_h") / _PREFIX_STEP).cast("int")
    )
    ranked = running_totals(keys, {"_no": F.lit(1)}, "_prefix", [F.col("_h"), F.col(key)], [label])
    return ranked.select(key, F.pmod(F.col("_no") - 1, F.lit(k)).cast("int").alias("fold"))


def with_folds(df: DataFrame, label: str, k: int = 5, key: str = ID, seed: int = 42) -> DataFrame:
    return null_safe_join(df, group_folds(df, label, k, key, seed), [key])


def fold_overlap(df: DataFrame, key: str = ID) -> DataFrame:
    """Number of keys that occur in more than one fold; 0 for a valid assignment."""
    per = df.select(key, "fold").distinct().groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("n_overlap"))


def union_classes(*parts: DataFrame) -> DataFrame:
    """Append samples by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_ids(a: DataFrame, b: DataFrame, columns: Sequence[str] = (ID,)) -> DataFrame:
    return a.select(*columns).intersect(b.select(*columns))


def missing_ids(a: DataFrame, b: DataFrame, columns: Sequence[str] = (ID,)) -> DataFrame:
    return a.select(*columns).subtract(b.select(*columns))

"""Exact quantiles, ranks, running curves and histograms on unbounded columns.

A global ``percentile`` gathers every distinct value in one task. Here equal
values are first merged into counts, the counts are sorted by range, part by part, and
only the wanted order statistics leave the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.operators.spread import in_range_parts, running_totals

def range_totals(
    rows: DataFrame,
    totals: Mapping[str, Column],
    order: str,
    by: Sequence[str] = (),
    inclusive: bool = True,
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sums in the order of one column, range by range.

    The result is that of :func:`running_totals`; rows that fit one range need only
    a window.
    """
    ranged, parts = in_range_parts(rows, [*by, order])
    if parts > 1:
        found = running_totals(ranged, totals, "_part", [F.col(order)], by, inclusive, whole)
        return found.select(*rows.columns, *totals, *(whole or {}))
    keys = list(by) or [F.lit(0)]
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1
    )
    every = Window.partitionBy(*keys)
    sums = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in totals.items()}
    sums |= {w: F.sum(totals[n]).over(every) for w, n in (whole or {}).items()}
    return ranged.withColumns(sums).drop("_part")


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: its count ``n``, the rows ``below`` it, all ``rows``
    and the ``total`` of all values as a double."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return range_totals(
        counts,
        {"below": F.col("n"), "_sum": F.col("n") * F.col(value).cast("double")},
        value,
        by,
        inclusive=False,
        whole={"rows": "below", "total": "_sum"},
    ).drop("_sum")


def distribution(
    df: DataFrame,
    value: str,
    probs: dict[str, float] | None = None,
    by: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """``n, mean, sd, min, max`` and exact quantiles, one row per group.

    One aggregation over the ranked value counts yields everything, so the input
    is read once. ``linear`` interpolates between the two neighbouring order
    statistics; ``nearest`` takes the value at position ``round(q * (n - 1))``.
    """
    if method not in ("linear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    by, probs = list(by), dict(probs or {})
    df = df.select(*by, F.col(value).alias("_value"))
    v, n = F.col("_value").cast("double"), F.col("n")
    picks = []
    for name, q in probs.items():
        h = (F.col("rows") - 1) * F.lit(float(q))
        lo, hi = (F.round(h), F.round(h)) if method == "nearest" else (F.floor(h), F.ceil(h))
        picks += [
            F.max(F.when(F.col("below") <= lo, v)).alias(f"_lo_{name}"),
            F.max(F.when(F.col("below") <= hi, v)).alias(f"_hi_{name}"),
        ]
    # Deviations from the mean: squares of the values themselves lose all digits
    # where the spread is small against the values.
    off = v - F.col("total") / F.col("rows")
    found = value_ranks(df, "_value", by).groupBy(*by).agg(
        F.sum("n").alias("_n"),
        F.sum(n * v).alias("_sum"),
        F.sum(n * off).alias("_off"),
        F.sum(n * off * off).alias("_squares"),
        F.min(v).alias("_min"),
        F.max(v).alias("_max"),
        *picks,
    )
    size = F.col("_n")
    spread = F.greatest(F.col("_squares") - F.col("_off") * F.col("_off") / size, F.lit(0.0))
    out = [
        size.alias("n"),
        (F.col("_sum") / size).alias("mean"),
        F.when(size > 1, F.sqrt(spread / (size - 1))).alias("sd"),
        F.col("_min").alias("min"),
        F.col("_max").alias("max"),
    ]
    for name, q in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        h = (size - 1) * F.lit(float(q))
        out.append((lo if method == "nearest" else lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return found.select(*by, *out)


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles, one row per group and one column per entry of ``probs``."""
    taken = {f"_q_{name}": q for name, q in probs.items()}
    return distribution(df, value, taken, by, method).select(*by, *[F.col(f"_q_{n}").alias(n) for n in probs])


def approx_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """One-pass approximate quantiles for interactive use."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value, float(q), accuracy).cast("double").alias(n) for n, q in probs.items()]
    )


def histogram(df: DataFrame, value: str, bins: int, log: bool = False) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, empty ones too.

    With ``log`` the bins are equal-width on a log10 axis and values of zero or
    less are left out, as on a logarithmic plot.
    """
    x = F.log10(F.col(value)) if log else F.col(value).cast("double")
    xs = df.where(F.col(value).isNotNull() & ((F.col(value) > 0) if log else F.lit(True))).select(x.alias("x"))
    span = xs.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    lo, hi = F.col("span.lo"), F.col("span.hi")
    width = (hi - lo) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1))).otherwise(0)
    counts = xs.withColumn("span", span).groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("span", span)
    return (
        edges.select("bin", (lo + F.col("bin") * width).alias("left"), (lo + (F.col("bin") + 1) * width).alias("right"))
        .join(counts, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )

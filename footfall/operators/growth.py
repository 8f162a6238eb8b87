"""Trends that change rarely, may change again, or saturate.

Three additions to the additive forecast: a fit whose changes of slope are sparse, an
interval from simulated future changes, and growth towards a cap. All sums run in
Spark; the driver holds matrices of the number of design columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import pi

import numpy as np
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.functions.scalars import hash_normal, hash_uniform
from footfall.operators.forecast import Z80, AdditiveFit, _design, _dot, _with_holidays
from footfall.session import materialize

HELD_TAIL = 0.2
STRENGTHS = 24


def second_moments(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sums of all products of two columns, in one pass over the rows."""
    k = len(columns)
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df.select(*columns))
    pairs = PolynomialExpansion(degree=2, inputCol="_x", outputCol="_xx").transform(rows)
    # Grouped, since the sum of no vectors is an error.
    found = pairs.groupBy(F.lit("all")).agg(Summarizer.sum(F.col("_xx")).alias("s")).first()
    out = np.zeros((k, k))
    if found is None:
        return out
    # Each column is followed by its products with the columns up to itself.
    values, at = found["s"].toArray(), 0
    for i in range(k):
        out[i, : i + 1] = out[: i + 1, i] = values[at + 1 : at + i + 2]
        at += i + 2
    return out


# --- sparse changes of the trend


@dataclass(frozen=True)
class SparseTrend:
    """The additive fit, the chosen strength, each hinge's penalty and the path tried."""

    fit: AdditiveFit
    strength: float
    penalties: dict[str, float]
    path: tuple[tuple[float, float, int], ...]

    def path_table(self, spark) -> DataFrame:
        rows = [(i, s, e, n, s == self.strength) for i, (s, e, n) in enumerate(self.path)]
        return spark.createDataFrame(rows, "step int, strength double, tail_mse double, n_changes int, best boolean")


def lasso(gram: np.ndarray, cross: np.ndarray, penalties: np.ndarray, start: np.ndarray, steps: int = 10_000) -> np.ndarray:
    """Minimum of ``b'Gb / 2 - c'b + sum(penalties * |b|)`` by a search over signs.

    While the non-zero coefficients meet their conditions, the zero one that violates its
    own the most gets a sign; then the equations of all signs are solved, and the way to
    that solution is followed to its best point, at most to where a coefficient is zero.
    """
    b = start.copy()
    usable = np.diag(gram) > 1e-14 * max(np.diag(gram).max(initial=0.0), 1e-300)
    slack = 1e-10 * max(np.abs(cross).max(initial=0.0), 1e-300)

    def height(x):
        return x @ gram @ x / 2 - cross @ x + penalties @ np.abs(x)

    for _ in range(steps):
        signs, slope = np.sign(b), cross - gram @ b
        settled = (np.abs(slope - penalties * signs) <= slack)[signs != 0].all()
        if settled:
            over = np.where((signs == 0) & usable, np.abs(slope) - penalties, -1.0)
            j = int(over.argmax()) if len(over) else 0
            if not len(over) or over[j] <= slack:
                break
            signs[j] = np.sign(slope[j])
        active = np.flatnonzero(signs)
        goal = np.zeros_like(b)
        goal[active] = np.linalg.lstsq(
            gram[np.ix_(active, active)], cross[active] - penalties[active] * signs[active], rcond=None
        )[0]
        ends = [goal]
        for k in np.flatnonzero((b != 0) & (np.sign(goal) != np.sign(b))):
            at = b + (goal - b) * (b[k] / (b[k] - goal[k]))
            at[k] = 0.0
            ends.append(at)
        best = min(ends, key=height)
        if height(best) >= height(b) and (settled or len(ends) == 1):
            break  # as close as rounding allows
        b = best
    return b


def _profiled(moments: np.ndarray, free: list[int], bent: list[int], y: int):
    """Moments of hinges and series with the free columns taken out, per row, and the way back."""
    zz, zh, zy = moments[np.ix_(free, free)], moments[np.ix_(free, bent)], moments[free, y]
    inverse = np.linalg.pinv(zz, rcond=1e-12, hermitian=True)
    n = moments[free[0], free[0]]
    gram = (moments[np.ix_(bent, bent)] - zh.T @ inverse @ zh) / n
    cross = (moments[bent, y] - zh.T @ inverse @ zy) / n
    return gram, cross, lambda delta: inverse @ (zy - zh @ delta)


def fit_sparse(
    series: DataFrame,
    yearly: int = 10,
    weekly: int = 3,
    changepoints: int = 25,
    holidays: DataFrame | None = None,
    tail: float = HELD_TAIL,
    strengths: int = STRENGTHS,
) -> SparseTrend:
    """Additive fit with an L1 penalty on the changes of slope and on nothing else.

    The strength is the one of a falling path, fitted on the head of the series, that
    forecasts the held-out tail best; the whole series is then fitted with it. Hinges
    are penalised in proportion to their spread beside the other columns.
    """
    series = materialize(series.select("ds", F.col("y").cast("double").alias("y")), "series")
    holidays = None if holidays is None else materialize(holidays.select("ds", "holiday"), "holidays")
    span = series.agg(F.min("ds"), F.max("ds")).first()
    start, days = span[0], float(max((span[1] - span[0]).days, 1))
    knots = tuple((1 - tail) * (i + 1) / (changepoints + 1) for i in range(changepoints))
    orders = {"yearly": yearly, "weekly": weekly}
    names = ()
    if holidays is not None:
        found = holidays.join(series.select("ds"), "ds", "left_semi").select("holiday").distinct()
        names = tuple(sorted(r[0] for r in found.collect()))
    frame, groups = _design(_with_holidays(series, holidays), start, days, knots, orders, names)
    frame = frame.withColumn("_one", F.lit(1.0))
    hinges = [c for c in groups["trend"] if c != "_t"]
    free = ["_one", *[c for g in groups.values() for c in g if c not in hinges]]
    columns = [*free, *hinges, "y"]
    zs, hs, y = list(range(len(free))), list(range(len(free), len(columns) - 1)), len(columns) - 1
    head = second_moments(frame.where(F.col("_t") <= 1 - tail), columns)
    rest = second_moments(frame.where(F.col("_t") > 1 - tail), columns)

    def solved(moments, strength, first):
        gram, cross, back = _profiled(moments, zs, hs, y)
        weights = np.sqrt(np.maximum(np.diag(gram), 0.0))
        delta = lasso(gram, cross, strength * weights, first)
        return delta, np.concatenate([back(delta), delta]), strength * weights

    gram, cross, _ = _profiled(head, zs, hs, y)
    weights = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    # From the strength at which no slope changes downwards.
    strongest = float((np.abs(cross) / weights).max(initial=0.0)) or 1.0
    delta, path = np.zeros(len(hs)), []
    for strength in strongest * np.logspace(0, -3, strengths):
        delta, all_of, _ = solved(head, strength, delta)
        error = all_of @ rest[:y, :y] @ all_of - 2 * all_of @ rest[:y, y] + rest[y, y]
        path.append((float(strength), float(error / max(rest[0, 0], 1.0)), int((delta != 0).sum())))
    best = min(path, key=lambda p: (p[1], -p[0]))[0]
    whole = head + rest
    delta, all_of, penalties = solved(whole, best, np.zeros(len(hs)))
    weight = dict(zip(columns, all_of.tolist()))
    squares = all_of @ whole[:y, :y] @ all_of - 2 * all_of @ whole[:y, y] + whole[y, y]
    fit = AdditiveFit(
        start,
        days,
        {g: tuple((c, weight[c]) for c in cols) for g, cols in groups.items()},
        weight["_one"],
        float(np.sqrt(max(squares, 0.0) / max(whole[0, 0], 1.0))),
        knots,
        orders,
        names,
    )
    return SparseTrend(fit, best, dict(zip(hinges, penalties.tolist())), tuple(path))


def sparse_equations(trend: SparseTrend, series: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """``term, n, of_series, of_fit, violation`` of every column's optimality condition.

    For a column without penalty the sums of column times series and of column times fit
    agree. For a hinge their difference per row is at most its penalty, and exactly
    that, with the sign of the coefficient, where the slope changes.
    """
    fit = trend.fit
    rows = _with_holidays(series.select("ds", F.col("y").cast("double").alias("y")), holidays)
    frame, groups = _design(rows, fit.start, fit.days, fit.knots, fit.orders, fit.holidays)
    frame = frame.withColumn("_one", F.lit(1.0))
    weights = {"_one": fit.intercept} | {c: w for g in fit.groups.values() for c, w in g}
    fitted = _dot([F.col(c) for c in weights], list(weights.values()))
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("term"),
                F.col(c).alias("x"),
                F.lit(float(w)).alias("weight"),
                F.lit(float(trend.penalties.get(c, 0.0))).alias("penalty"),
            )
            for c, w in weights.items()
        ]
    )
    slope = (F.col("of_series") - F.col("of_fit")) / F.col("n")
    return (
        frame.select("y", fitted.alias("f"), F.explode(cells).alias("c"))
        .groupBy("c.term", "c.weight", "c.penalty")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("c.x") * F.col("y")).alias("of_series"),
            F.sum(F.col("c.x") * F.col("f")).alias("of_fit"),
        )
        .select(
            "term",
            "n",
            "of_series",
            "of_fit",
            F.when(F.col("weight") != 0, F.abs(slope - F.signum("weight") * F.col("penalty")))
            .otherwise(F.greatest(F.abs(slope) - F.col("penalty"), F.lit(0.0)))
            .alias("violation"),
        )
    )


# --- future changes of the trend


def simulated_changes(fit: AdditiveFit, dates: DataFrame, last, paths: int = 1_000, seed: int = 148) -> DataFrame:
    """``ds, lower, upper``: 80% range of what lies ahead beside the forecast.

    After ``last`` every path may change its slope on any date, as often on average as
    the fit had changepoints and by a Laplace draw as large as its changes; noise of the
    residuals' size is added. Draws are hashes of path and date, so they repeat. The
    deviation of a path is a prefix sum along its dates.
    """
    sizes = [abs(w) for c, w in fit.groups.get("trend", ()) if c != "_t"]
    scale = sum(sizes) / len(sizes) if sizes else 0.0
    ahead = dates.where(F.col("ds") > F.lit(last)).select(
        "ds", (F.datediff("ds", F.lit(fit.start)) / F.lit(fit.days)).alias("t")
    )
    # One row per date.
    before = F.lag("t", 1).over(Window.orderBy("t"))
    here = F.datediff(F.lit(last), F.lit(fit.start)) / F.lit(fit.days)
    steps = ahead.withColumn("chance", (F.col("t") - F.coalesce(before, here)) * F.lit(float(len(fit.knots))))
    drawn = steps.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    day = F.date_format("ds", "yyyy-MM-dd")
    side = hash_uniform(F.col("path"), day, seed, 2) - F.lit(0.5)
    laplace = -F.signum(side) * F.log(F.greatest(1 - 2 * F.abs(side), F.lit(1e-12))) * F.lit(scale)
    change = F.when(hash_uniform(F.col("path"), day, seed, 1) < F.col("chance"), laplace).otherwise(F.lit(0.0))
    along = Window.partitionBy("path").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = drawn.withColumn("size", change).withColumns(
        {"slope": F.sum("size").over(along), "shift": F.sum(F.col("size") * F.col("t")).over(along)}
    )
    noise = hash_normal(F.col("path"), day, seed + 1) * F.lit(fit.residual_sd)
    value = F.col("t") * F.col("slope") - F.col("shift") + noise
    return (
        moved.select("ds", value.alias("v"))
        .groupBy("ds")
        .agg(F.percentile("v", 0.1).alias("lower"), F.percentile("v", 0.9).alias("upper"))
    )


def with_simulated_interval(fit: AdditiveFit, forecast: DataFrame, last, paths: int = 1_000, seed: int = 148) -> DataFrame:
    """The forecast with its interval replaced after ``last`` by that of simulated paths."""
    ranges = simulated_changes(fit, forecast.select("ds"), last, paths, seed)
    near = F.lit(Z80 * fit.residual_sd)
    out = forecast.join(ranges, "ds", "left").withColumns(
        {
            "yhat_lower": F.col("yhat") + F.coalesce("lower", -near),
            "yhat_upper": F.col("yhat") + F.coalesce("upper", near),
        }
    )
    return out.drop("lower", "upper")


# --- growth towards a cap


@dataclass(frozen=True)
class SaturatingFit:
    """``cap / (1 + exp(-x'beta))`` with a trend and yearly waves in ``x``."""

    start: object
    days: float
    cap: float
    yearly: int
    beta: np.ndarray
    spread: float

    @property
    def terms(self) -> list[str]:
        waves = [f"{w}{n}" for n in range(1, self.yearly + 1) for w in ("sin", "cos")]
        return ["one", "t", *waves]


def _waves(start, days: float, yearly: int) -> list[Column]:
    age = F.datediff("ds", F.lit(start)) / F.lit(days)
    epoch_day = F.datediff("ds", F.to_date(F.lit("1970-01-01")))
    angles = [epoch_day * F.lit(2 * pi * n / 365.25) for n in range(1, yearly + 1)]
    return [F.lit(1.0), age, *[f(a) for a in angles for f in (F.sin, F.cos)]]


def _share(eta: Column) -> Column:
    return 1 / (1 + F.exp(-eta))


def _normal_equations(rows: DataFrame, beta: np.ndarray, cap: float):
    """Sum of squares, gradient and Gauss-Newton matrix at ``beta``."""
    k = len(beta)
    xs = [F.col("x")[i] for i in range(k)]
    at = rows.withColumn("s", _share(_dot(xs, beta))).withColumns(
        {"r": F.col("y") - F.lit(cap) * F.col("s"), "g": F.lit(cap) * F.col("s") * (1 - F.col("s"))}
    )
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = at.agg(
        F.sum(F.col("r") * F.col("r")).alias("sse"),
        *[F.sum(F.col("r") * F.col("g") * xs[i]).alias(f"b{i}") for i in range(k)],
        *[F.sum(F.col("g") * F.col("g") * xs[i] * xs[j]).alias(f"a{i}_{j}") for i, j in cells],
        F.avg(F.pow(F.col("r") / F.col("g"), 2)).alias("spread"),
    ).first()
    matrix = np.zeros((k, k))
    for i, j in cells:
        matrix[i, j] = matrix[j, i] = sums[f"a{i}_{j}"]
    return sums["sse"], np.array([sums[f"b{i}"] for i in range(k)]), matrix, sums["spread"]


def fit_saturating(series: DataFrame, cap: float, yearly: int = 2, steps: int = 60) -> SaturatingFit:
    """Least squares by damped Gauss-Newton steps; each is one aggregation in Spark.

    Trend and waves act inside the logistic curve, so the fit stays between 0 and the
    cap on any date.
    """
    series = materialize(series.select("ds", F.col("y").cast("double").alias("y")), "series")
    span = series.agg(F.min("ds"), F.max("ds"), F.avg("y")).first()
    start, days = span[0], float(max((span[1] - span[0]).days, 1))
    rows = materialize(series.select("y", F.array(*_waves(start, days, yearly)).alias("x")), "saturating")
    beta = np.zeros(2 + 2 * yearly)
    middle = min(max(span[2] / cap, 0.01), 0.99)
    beta[0] = np.log(middle / (1 - middle))
    damping = 1e-3
    error, gradient, matrix, spread = _normal_equations(rows, beta, cap)
    for _ in range(steps):
        scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
        if np.abs(gradient / scale).max() <= 1e-9 * max(np.sqrt(error), 1e-300):
            break
        step = np.linalg.lstsq(matrix + damping * np.diag(scale**2), gradient, rcond=None)[0]
        found = _normal_equations(rows, beta + step, cap)
        if found[0] <= error:
            beta, damping = beta + step, damping / 10
            error, gradient, matrix, spread = found
        else:
            damping *= 10
    return SaturatingFit(start, days, float(cap), yearly, beta, float(np.sqrt(spread or 0.0)))


def saturating_equations(fit: SaturatingFit, series: DataFrame) -> DataFrame:
    """``term, n, score``: the residuals' sums that a least-squares fit brings to zero."""
    k = len(fit.beta)
    rows = series.select(F.col("y").cast("double").alias("y"), F.array(*_waves(fit.start, fit.days, fit.yearly)).alias("x"))
    s = _share(_dot([F.col("x")[i] for i in range(k)], fit.beta))
    slope = (F.col("y") - F.lit(fit.cap) * F.col("s")) * F.col("s") * (1 - F.col("s"))
    names = F.array(*[F.lit(t) for t in fit.terms])
    return (
        rows.withColumn("s", s)
        .select(slope.alias("r"), F.explode(F.arrays_zip(names.alias("term"), F.col("x").alias("x"))).alias("c"))
        .groupBy("c.term")
        .agg(F.count("*").alias("n"), (F.sum(F.col("r") * F.col("c.x")) / F.count("*")).alias("score"))
    )


def forecast_saturating(fit: SaturatingFit, dates: DataFrame) -> DataFrame:
    """``ds, yhat, yhat_lower, yhat_upper``, all between 0 and the cap without clipping."""
    eta = _dot(_waves(fit.start, fit.days, fit.yearly), fit.beta)
    spread = F.lit(Z80 * fit.spread)
    cap = F.lit(fit.cap)
    return dates.select(
        "ds",
        (cap * _share(eta)).alias("yhat"),
        (cap * _share(eta - spread)).alias("yhat_lower"),
        (cap * _share(eta + spread)).alias("yhat_upper"),
    )

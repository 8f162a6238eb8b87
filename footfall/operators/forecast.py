"""Seasonal Poisson regression and an additive trend-and-season model.

Series have one row per period, so fits are small; design columns, sums and
predictions are Spark expressions and the driver only holds coefficients.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import erf, exp, pi, sqrt

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalars import clip, hash_normal
from footfall.functions.times import align_to_year
from footfall.operators.features import fill_median
from footfall.operators.series import seasonal_design
from footfall.session import materialize

SEASONAL_TERMS = ("trend_month", "sin_annual", "cos_annual", "sin_semiannual", "cos_semiannual")
Z95 = 1.959963984540054
Z80 = 1.2815515655446004
CALENDAR_COLUMNS = ("orders_yhat", "orders_trend", "orders_weekly", "orders_yearly", "orders_holidays")


@dataclass(frozen=True)
class PoissonFit:
    """Coefficients (intercept first) with their robust covariance."""

    start: object
    terms: tuple[str, ...]
    beta: np.ndarray
    cov: np.ndarray

    def table(self, spark) -> DataFrame:
        """Estimate, 95% interval, p-value and multiplicative effect per term."""
        se = np.sqrt(np.diag(self.cov))
        rows = []
        for name, b, s in zip(self.terms, self.beta, se):
            p = 1.0 - erf(abs(b / s) / sqrt(2.0)) if s > 0 else 0.0
            rows.append((name, float(b), float(b - Z95 * s), float(b + Z95 * s), float(p), exp(b)))
        return spark.createDataFrame(
            rows,
            "term string, estimate double, conf_low double, conf_high double, p_value double, multiplicative_effect double",
        )


def _x(terms: Sequence[str]) -> list[Column]:
    return [F.lit(1.0) if t == "intercept" else F.col(t) for t in terms]


def _dot(xs: Sequence[Column], values) -> Column:
    return sum((x * F.lit(float(v)) for x, v in zip(xs, values)), F.lit(0.0))


def fit_poisson(series: DataFrame, start=None) -> PoissonFit:
    """Log-linear Poisson fit of ``y`` on trend and two seasonal waves, HC0 covariance.

    The fit makes several passes, so the short series is written first and the
    log behind it is read once.
    """
    series = materialize(series.select("ds", "y"), "series")
    start = series.agg(F.min("ds")).first()[0] if start is None else start
    design = seasonal_design(series, F.lit(start))
    assembled = VectorAssembler(inputCols=list(SEASONAL_TERMS), outputCol="_x").transform(
        design.withColumn("y", F.col("y").cast("double"))
    )
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol="y", tol=1e-10, maxIter=100)
    model = glm.fit(assembled)
    terms = ("intercept", *SEASONAL_TERMS)
    beta = np.array([model.intercept, *model.coefficients.toArray()])

    xs = _x(terms)
    mu = F.exp(_dot(xs, beta))
    cells = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = design.agg(
        *[F.sum(mu * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in cells],
        *[F.sum(F.pow(F.col("y") - mu, 2) * xs[i] * xs[j]).alias(f"m{i}_{j}") for i, j in cells],
    ).first()
    bread, meat = np.zeros((len(terms),) * 2), np.zeros((len(terms),) * 2)
    for i, j in cells:
        bread[i, j] = bread[j, i] = sums[f"h{i}_{j}"]
        meat[i, j] = meat[j, i] = sums[f"m{i}_{j}"]
    inverse = np.linalg.inv(bread)
    return PoissonFit(start, terms, beta, inverse @ meat @ inverse)


def forecast_poisson(fit: PoissonFit, future: DataFrame) -> DataFrame:
    """Mean and 95% interval per future month, never below 0."""
    xs = _x(fit.terms)
    eta = _dot(xs, fit.beta)
    var = sum((_dot(xs, row) * x for x, row in zip(xs, fit.cov)), F.lit(0.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    design = seasonal_design(future, F.lit(fit.start))
    return design.select(
        "ds",
        clip(F.exp(eta), 0.0).alias("predicted_mean"),
        clip(F.exp(eta - Z95 * se), 0.0).alias("ci_lower"),
        clip(F.exp(eta + Z95 * se), 0.0).alias("ci_upper"),
    )


def annual_interval(fit: PoissonFit, future: DataFrame, draws: int = 20_000, seed: int = 148) -> DataFrame:
    """Total over the future months with a simulated 95% interval.

    Coefficients are drawn around the fit through a square root of its
    covariance; the few months travel with every draw as one array.
    """
    spark = future.sparkSession
    k = len(fit.terms)
    eigen, basis = np.linalg.eigh((fit.cov + fit.cov.T) / 2)
    root = basis @ np.diag(np.sqrt(np.clip(eigen, 0, None)))
    design = seasonal_design(future, F.lit(fit.start))
    months = design.agg(F.collect_list(F.array(*_x(fit.terms)))).scalar()
    drawn = spark.range(draws).select(F.array(*[hash_normal("id", j, seed) for j in range(k)]).alias("z")).select(
        F.array(
            *[F.lit(float(fit.beta[i])) + _dot([F.col("z")[j] for j in range(k)], root[i]) for i in range(k)]
        ).alias("b")
    )

    def month_mean(x):
        terms = [x[i] * F.col("b")[i] for i in range(k)]
        return F.exp(sum(terms[1:], terms[0]))

    totals = drawn.withColumn("_months", months).select(
        F.aggregate("_months", F.lit(0.0), lambda acc, x: acc + month_mean(x)).alias("total")
    )
    mean = forecast_poisson(fit, future).agg(F.sum("predicted_mean")).scalar()
    return totals.agg(
        F.percentile("total", 0.025).alias("ci_lower"), F.percentile("total", 0.975).alias("ci_upper")
    ).select(mean.alias("predicted_mean"), "ci_lower", "ci_upper")


@dataclass(frozen=True)
class AdditiveFit:
    """Coefficients per component and the residual deviation."""

    start: object
    days: float
    groups: Mapping[str, tuple[tuple[str, float], ...]]
    intercept: float
    residual_sd: float
    knots: tuple[float, ...]
    orders: Mapping[str, int]
    holidays: tuple[str, ...] = field(default=())

    @property
    def components(self) -> list[str]:
        return list(self.groups)


def _design(df: DataFrame, start, days: float, knots, orders: Mapping[str, int], holiday_names) -> tuple[DataFrame, dict[str, list[str]]]:
    age = F.datediff("ds", F.lit(start)).cast("double")
    t = age / F.lit(days)
    cells, groups = {"_t": t}, {"trend": ["_t"]}
    for i, c in enumerate(knots):
        cells[f"_h{i}"] = F.greatest(t - F.lit(float(c)), F.lit(0.0))
        groups["trend"].append(f"_h{i}")
    # Days since 1970 keep the phase independent of the series start.
    epoch_day = F.datediff("ds", F.to_date(F.lit("1970-01-01"))).cast("double")
    for name, period in (("yearly", 365.25), ("weekly", 7.0)):
        for n in range(1, orders.get(name, 0) + 1):
            angle = epoch_day * F.lit(2 * pi * n / period)
            cells[f"_{name}_s{n}"], cells[f"_{name}_c{n}"] = F.sin(angle), F.cos(angle)
            groups.setdefault(name, []).extend([f"_{name}_s{n}", f"_{name}_c{n}"])
    for i, name in enumerate(holiday_names):
        cells[f"_hol{i}"] = F.coalesce(F.array_contains("_holidays", name).cast("double"), F.lit(0.0))
        groups.setdefault("holidays", []).append(f"_hol{i}")
    return df.withColumns(cells), groups


def _with_holidays(df: DataFrame, holidays: DataFrame | None) -> DataFrame:
    if holidays is None:
        return df
    per_day = holidays.groupBy("ds").agg(F.collect_set("holiday").alias("_holidays"))
    return df.join(per_day, "ds", "left")


def fit_additive(
    series: DataFrame,
    yearly: int = 10,
    weekly: int = 3,
    changepoints: int = 25,
    holidays: DataFrame | None = None,
    ridge: float = 0.01,
) -> AdditiveFit:
    """Ridge fit of trend with hinges, yearly and weekly waves and holiday effects.

    The fit makes several passes, so the short series is written first.
    """
    series = materialize(series.select("ds", "y"), "series")
    holidays = None if holidays is None else materialize(holidays.select("ds", "holiday"), "holidays")
    span = series.agg(F.min("ds"), F.max("ds")).first()
    start, days = span[0], float(max((span[1] - span[0]).days, 1))
    # Hinges lie in the first 80 percent of the series.
    knots = tuple(0.8 * (i + 1) / (changepoints + 1) for i in range(changepoints))
    orders = {"yearly": yearly, "weekly": weekly}
    names = ()
    if holidays is not None:
        names = tuple(sorted(r[0] for r in holidays.join(series.select("ds"), "ds", "left_semi").select("holiday").distinct().collect()))
    frame, groups = _design(_with_holidays(series, holidays), start, days, knots, orders, names)
    columns = [c for g in groups.values() for c in g]
    assembled = VectorAssembler(inputCols=columns, outputCol="_x").transform(frame.withColumn("y", F.col("y").cast("double")))
    model = LinearRegression(
        featuresCol="_x", labelCol="y", regParam=ridge, elasticNetParam=0.0, standardization=False, solver="normal"
    ).fit(assembled)
    weights = dict(zip(columns, (float(v) for v in model.coefficients.toArray())))
    return AdditiveFit(
        start,
        days,
        {g: tuple((c, weights[c]) for c in cols) for g, cols in groups.items()},
        float(model.intercept),
        float(model.summary.rootMeanSquaredError),
        knots,
        orders,
        names,
    )


def forecast_additive(
    fit: AdditiveFit, dates: DataFrame, holidays: DataFrame | None = None, floor: float | None = None, cap: float | None = None
) -> DataFrame:
    """``ds, yhat, yhat_lower, yhat_upper`` and one column per component.

    Components that the fit does not have are 0; ``yhat`` is their sum, clipped
    to ``[floor, cap]`` where given.
    """
    frame, _ = _design(_with_holidays(dates.select("ds"), holidays), fit.start, fit.days, fit.knots, fit.orders, fit.holidays if holidays is not None else ())
    usable = set(frame.columns)
    parts = {}
    for name in ("trend", "weekly", "yearly", "holidays"):
        terms = [F.col(c) * F.lit(w) for c, w in fit.groups.get(name, ()) if c in usable]
        parts[name] = sum(terms, F.lit(fit.intercept if name == "trend" else 0.0))
    out = frame.select("ds", *[v.alias(k) for k, v in parts.items()])
    yhat = F.col("trend") + F.col("weekly") + F.col("yearly") + F.col("holidays")
    spread = F.lit(Z80 * fit.residual_sd)
    return out.withColumns(
        {
            "yhat": clip(yhat, floor, cap),
            "yhat_lower": clip(yhat - spread, floor, cap),
            "yhat_upper": clip(yhat + spread, floor, cap),
        }
    )


def fixed_date_holidays(dates: DataFrame, days: Mapping[str, tuple[int, int]]) -> DataFrame:
    """``ds, holiday`` for holidays that fall on the same month and day each year."""
    parts = [
        dates.where((F.month("ds") == m) & (F.dayofmonth("ds") == d)).select("ds", F.lit(n).alias("holiday"))
        for n, (m, d) in days.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weekday_holidays(dates: DataFrame, days: Mapping[str, tuple[int, int, int]]) -> DataFrame:
    """``ds, holiday`` for holidays on a weekday of a month: (month, weekday, number).

    Weekdays count from 1 for Sunday as in ``dayofweek``; number 1 is the first of
    the month and -1 the last.
    """

    def falls(month: int, weekday: int, number: int) -> Column:
        here = (F.month("ds") == month) & (F.dayofweek("ds") == weekday)
        if number > 0:
            return here & (F.ceil(F.dayofmonth("ds") / 7) == number)
        return here & (F.ceil((F.dayofmonth(F.last_day("ds")) - F.dayofmonth("ds") + 1) / 7) == -number)

    found = F.array_compact(F.array(*[F.when(falls(*d), F.lit(n)) for n, d in days.items()]))
    return dates.select("ds", F.explode(found).alias("holiday"))


def calendar_features(forecast: DataFrame) -> DataFrame:
    """The forecast as daily features; absent components are 0."""
    have = set(forecast.columns)
    source = ("yhat", "trend", "weekly", "yearly", "holidays")
    return forecast.select(
        F.to_date("ds").alias("feature_ds"),
        *[(F.col(s) if s in have else F.lit(0.0)).alias(n) for s, n in zip(source, CALENDAR_COLUMNS)],
    )


def with_calendar_features(df: DataFrame, features: DataFrame, ts: str = "last_action_ts") -> DataFrame:
    """Join the features of the last-action day; days without any get the medians."""
    joined = df.withColumn("feature_ds", F.to_date(ts)).join(features, "feature_ds", "left").drop("feature_ds")
    return fill_median(joined, CALENDAR_COLUMNS, features)


def holiday_yoy(forecast: DataFrame, year: int = 2023) -> DataFrame:
    """Holiday effect with every date moved to one year, for comparing years."""
    return forecast.select(F.year("ds").alias("year"), align_to_year("ds", year).alias("aligned_ds"), "ds", "holidays")


def training_summary(cutoff_days: Column, daily: DataFrame, train: DataFrame, forecast: DataFrame) -> DataFrame:
    """Key and value of the forecast's training choices."""
    facts = daily.agg(F.min("ds").alias("first")).select(
        cutoff_days.cast("int").cast("string").alias("success_journey_length_days"),
        F.date_add("first", cutoff_days.cast("int")).cast("string").alias("start_cutoff"),
        train.agg(F.count("*")).scalar().cast("string").alias("daily_train_rows_weekdays_only"),
        forecast.agg(F.max("ds")).scalar().cast("string").alias("forecast_end"),
    )
    return facts.unpivot([], facts.columns, "key", "value")

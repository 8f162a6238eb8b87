"""Classification metrics on score tables ``label, p``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from footfall.functions.scalars import to_class
from footfall.operators.quantiles import distribution, range_totals


def accuracy(df: DataFrame, label: str = "label", p: str = "p", t: float = 0.5) -> DataFrame:
    return df.agg(F.avg((to_class(p, t) == F.col(label)).cast("int")).alias("accuracy"))


def confusion(df: DataFrame, label: str = "label", p: str = "p", t: float = 0.5) -> DataFrame:
    """Rows per true and predicted class; combinations that do not occur are 0."""
    hits = df.groupBy().agg(
        *[
            F.count_if((F.col(label) == y) & (to_class(p, t) == c)).alias(f"n{y}{c}")
            for y in (0, 1)
            for c in (0, 1)
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(c).alias("predicted"), F.col(f"n{y}{c}").alias("n"))
            for y in (0, 1)
            for c in (0, 1)
        ]
    )
    return hits.select(F.explode(cells).alias("r")).select("r.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, label: str = "label", p: str = "p", t: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages."""
    n = {
        (y, c): F.col(f"n{y}{c}") for y in (0, 1) for c in (0, 1)
    }
    base = df.groupBy().agg(
        *[F.count_if((F.col(label) == y) & (to_class(p, t) == c)).alias(f"n{y}{c}") for y in (0, 1) for c in (0, 1)]
    )
    parts = {}
    for k in (0, 1):
        precision = _ratio(n[k, k], n[0, k] + n[1, k])
        recall = _ratio(n[k, k], n[k, 0] + n[k, 1])
        f1 = _ratio(2 * precision * recall, precision + recall)
        parts[str(k)] = (precision, recall, f1, n[k, 0] + n[k, 1])
    s0, s1 = parts["0"][3], parts["1"][3]
    mean = [(a + b) / 2 for a, b in zip(parts["0"][:3], parts["1"][:3])]
    weighted = [_ratio(a * s0 + b * s1, s0 + s1) for a, b in zip(parts["0"][:3], parts["1"][:3])]
    parts["macro"] = (*mean, s0 + s1)
    parts["weighted"] = (*weighted, s0 + s1)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("class"),
                v[0].alias("precision"),
                v[1].alias("recall"),
                v[2].alias("f1"),
                v[3].alias("support"),
            )
            for k, v in parts.items()
        ]
    )
    return base.select(F.explode(rows).alias("r")).select("r.*")


def brier(df: DataFrame | GroupedData, label: str = "label", p: str = "p") -> DataFrame:
    """Mean squared difference of score and class, of a table or of each of its groups."""
    return df.agg(F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))


def score_curve(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Per distinct score: positives and negatives at it and above it.

    Scores are merged first; running counts come from ranges of scores plus the order
    inside each range.
    """
    at = df.groupBy(F.col(p).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # Negated so that the highest score comes first.
    at = at.withColumn("_down", -F.col("score"))
    return range_totals(at, {"tp": F.col("pos"), "fp": F.col("neg")}, "_down").drop("_down")


def average_precision(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Step-wise area under the precision-recall curve over distinct scores; null without positives."""
    curve = score_curve(df, label, p)
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve.agg(F.try_divide(gain, F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Probability that a positive outranks a negative; ties count half; null for one class only."""
    curve = score_curve(df, label, p)
    # Positives above each negative score, plus half of those at it.
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    return curve.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def sensitivity_specificity(df: DataFrame, label: str = "label", p: str = "p", t: float = 0.5) -> DataFrame:
    yes = to_class(p, t) == 1
    return df.agg(
        _ratio(F.count_if((F.col(label) == 1) & yes), F.count_if(F.col(label) == 1)).alias("sensitivity"),
        _ratio(F.count_if((F.col(label) == 0) & ~yes), F.count_if(F.col(label) == 0)).alias("specificity"),
    )


def mean_probability(df: DataFrame, p: str = "p") -> DataFrame:
    return df.agg(F.avg(p).alias("mean_p"))


def evaluate(df: DataFrame, label: str = "label", p: str = "p", t: float = 0.5) -> DataFrame:
    """All measures in one row, from one pass over the scored table.

    Every measure is a sum over distinct scores with their positives and
    negatives, so the score curve is all that is needed.
    """
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    yes = s >= F.lit(t)
    hit, calm = F.sum(F.when(yes, pos).otherwise(0)), F.sum(F.when(yes, 0).otherwise(neg))
    all_pos, all_neg = F.sum(pos), F.sum(neg)
    rows = all_pos + all_neg
    return score_curve(df, label, p).agg(
        F.try_divide(hit + calm, rows).alias("accuracy"),
        _ratio(hit, all_pos).alias("sensitivity"),
        _ratio(calm, all_neg).alias("specificity"),
        F.try_divide(F.sum(pos * F.pow(s - 1, 2) + neg * F.pow(s, 2)), rows).alias("brier"),
        F.try_divide(F.sum(pos * F.col("tp") / (F.col("tp") + F.col("fp"))), all_pos).alias("average_precision"),
        F.try_divide(
            F.sum(neg.cast("double") * (F.col("tp") - pos / 2)), all_pos.cast("double") * all_neg
        ).alias("roc_auc"),
        F.try_divide(F.sum((pos + neg) * s), rows).alias("mean_p"),
    )


def prediction_summary(df: DataFrame, p: str = "p") -> DataFrame:
    """Mean, deviation, extremes, median and count of predictions."""
    return distribution(df, p, {"median": 0.5})


def class_share(df: DataFrame, p: str = "p", t: float = 0.5) -> DataFrame:
    """Share of rows predicted positive."""
    return df.agg(F.avg(to_class(p, t)).alias("share_positive"))


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def compare_predictions(a: DataFrame, b: DataFrame, key: str = "id", p: str = "p") -> DataFrame:
    """Two prediction sets side by side with the difference b - a."""
    left = a.select(key, F.col(p).alias("p_a"))
    right = b.select(key, F.col(p).alias("p_b"))
    return left.join(right, key).withColumn("delta", F.col("p_b") - F.col("p_a"))

"""Bagged trees whose draws are known, and out-of-bag votes.

Spark's forests keep their bootstrap draws to themselves. Here the number of times a
row enters a tree is a Poisson(1) draw from a hash of its key and the tree, so the
table need not be copied per tree, a retried task draws the same, and it is known
which trees never saw a row. With the journey id as key all rows of a journey enter
a tree together or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import exp, factorial
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.scalars import HASH_SPAN, hash_number
from footfall.operators.models import FOREST_SETTINGS
from footfall.schema import ID
from footfall.session import materialize

MOST_DRAWS = 12
SCORED_AT_ONCE = 25


def poisson_bars(most: int = MOST_DRAWS) -> list[int]:
    """The hash values from which a Poisson(1) draw is at least 1, 2, ..."""
    below, bars = 0.0, []
    for k in range(most):
        below += exp(-1.0) / factorial(k)
        bars.append(int(below * HASH_SPAN))
    return bars


def draws(tree: int, key: str = ID, seed: int = 42) -> Column:
    """How often a row is drawn for a tree; a null key is a key of its own."""
    number = hash_number(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree, seed)
    return sum((F.when(number >= bar, 1).otherwise(0) for bar in poisson_bars()), F.lit(0))


@dataclass(frozen=True)
class Bag:
    """One model per tree; tree ``i`` was fitted on ``draws(i, key, seed)``."""

    trees: tuple[RandomForestClassificationModel, ...]
    features: tuple[str, ...]
    key: str
    seed: int


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)


def fit_bag(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    key: str = ID,
    seed: int = 42,
    parallelism: int = 8,
    numTrees: int = FOREST_SETTINGS["baseline"]["numTrees"],
    **params,
) -> Bag:
    """Fit every tree on its own weighted draw of the rows.

    The loop runs over trees, some at a time as in Spark's own cross-validation;
    each turn is one distributed fit on the table, which is written once.
    """
    settings = {
        "maxDepth": 12,
        "featureSubsetStrategy": "sqrt",
        "minInstancesPerNode": FOREST_SETTINGS["baseline"]["minInstancesPerNode"],
        **params,
    }
    table = materialize(_assembled(df.select(key, label, *features), features).select(key, label, "_x"), "bag")

    def fit(tree: int):
        drawn = table.withColumn("_w", draws(tree, key, seed).cast("double")).where("_w > 0")
        one = RandomForestClassifier(
            numTrees=1, bootstrap=False, labelCol=label, featuresCol="_x", weightCol="_w", seed=seed + tree, **settings
        )
        return one.fit(drawn)

    with ThreadPool(parallelism) as pool:
        return Bag(tuple(pool.map(fit, range(numTrees), chunksize=1)), tuple(features), key, seed)


def oob_votes(bag: Bag, df: DataFrame) -> DataFrame:
    """The rows with ``voters``, the trees that did not draw them, and ``p``, the mean
    probability these trees give; null where every tree drew the row."""
    columns = df.columns
    table = _assembled(df, bag.features).withColumns(
        {"voters": F.array().cast("array<int>"), "_sum": F.lit(0.0)}
    )
    for start in range(0, len(bag.trees), SCORED_AT_ONCE):
        for tree in range(start, min(len(bag.trees), start + SCORED_AT_ONCE)):
            model = bag.trees[tree]
            model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
            out_of_bag = draws(tree, bag.key, bag.seed) == 0
            table = model.transform(table).select(
                *columns,
                "_x",
                F.when(out_of_bag, F.concat("voters", F.array(F.lit(tree)))).otherwise(F.col("voters")).alias("voters"),
                (F.col("_sum") + F.when(out_of_bag, vector_to_array("_p")[1]).otherwise(0.0)).alias("_sum"),
            )
        # The chain of models would grow without end; the rows are written between its parts.
        table = materialize(table, "votes")
    voters = F.size("voters")
    return table.select(*columns, "voters", F.when(voters > 0, F.col("_sum") / voters).alias("p"))


def oob_accuracy(votes: DataFrame, label: str = "label") -> DataFrame:
    """Share of rows with a vote, and accuracy and Brier score over these."""
    y, p = F.col(label).cast("double"), F.col("p")
    return votes.agg(
        F.count("*").alias("n_rows"),
        F.count("p").alias("n_voted"),
        F.avg(F.size("voters")).alias("mean_voters"),
        F.avg(F.when(p.isNotNull(), ((p >= 0.5).cast("double") == y).cast("double"))).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"),
    )

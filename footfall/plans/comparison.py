"""Two feature variants judged on the same folds and scored on the same journeys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.metrics import compare_predictions, correlation, evaluate, prediction_summary
from footfall.operators.models import fit_gbt, score
from footfall.schema import ID
from footfall.session import materialize

# Rows that one task of a boosted fit goes through, at least, about.
FIT_ROWS = 250_000


def compare_variants(
    train: DataFrame,
    test: DataFrame,
    variants: Mapping[str, Sequence[str]],
    fold: int = 0,
    seed: int = 90,
    **params,
) -> tuple[DataFrame, DataFrame]:
    """Metrics per variant, and the two variants' predictions side by side.

    ``train`` carries ``label`` and ``fold``. Each variant is validated on the
    held-out fold, refitted on all rows of ``train`` and applied to ``test``, which
    should hold other journeys, one row each. The four fits run side by side; as each of
    their many jobs is short, they read ``train`` in parts of ``FIT_ROWS`` rows or more.
    """
    if len(variants) != 2:
        raise ValueError("give exactly two variants")
    # Nothing is shuffled, and a table that already has fewer parts keeps them.
    whole = train.coalesce(max(1, -(-train.count() // FIT_ROWS)))
    known = whole.where(F.col("fold") != fold)
    jobs = [(rows, features) for features in variants.values() for rows in (known, whole)]
    with ThreadPool(len(jobs)) as pool:
        fit = inheritable_thread_target(train.sparkSession)(lambda job: fit_gbt(*job, seed=seed, **params))
        fitted = pool.map(fit, jobs, chunksize=1)
    rows, predictions = [], []
    for i, (name, features) in enumerate(variants.items()):
        checked, refitted = fitted[2 * i : 2 * i + 2]
        quality = evaluate(score(checked, train.where(F.col("fold") == fold)))
        final = materialize(score(refitted, test).select(ID, "p"), "variant-scores")
        predictions.append(final)
        summary = prediction_summary(final)
        rows.append(
            quality.withColumns(
                {
                    "variant": F.lit(name),
                    "n_features": F.lit(len(features)),
                    **{f"pred_{c}": summary.select(c).scalar() for c in summary.columns},
                }
            )
        )
    side_by_side = compare_predictions(*predictions)
    metrics = rows[0].unionByName(rows[1]).withColumn("corr", correlation(side_by_side, "p_a", "p_b").scalar())
    return metrics, side_by_side

"""Quality rules whose cutoffs come with a bound on false rejections.

A rule rejects a text whose ratio lies above a cutoff. Cutoffs are chosen per
stratum (``lang``) on labelled holdout rows. For a grid of fixed cutoffs, tried
from the most lenient to the strictest, the exact binomial (Clopper-Pearson)
upper bound on the share of good texts rejected is compared with the allowed
share; the sequence stops at the first cutoff that fails, so every certified
cutoff of a sequence holds at once without paying for the grid. The error level
is divided by strata times rules (Bonferroni), the allowed share by the rules.
Among certified cutoffs the one that separates the labels best is used, at
``FALSE_COST`` per false rejection; a rule
that separates nothing, or a stratum with too few labels, rejects nothing.

Defined results: a null or empty text has no words and fails the base check; a
null ``lang`` is a stratum of its own; rows with the same id are judged one by
one; an id with labels of both kinds counts as no label; empty tables give no
cutoffs and an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_columns, written

WINDOW = 8
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
NO_VALUE = "\0null"

# Ratios the rules look at: expressions over the statistics of a text.
RATIOS = {
    "symbols_per_word": "n_symbols / n_words",
    "marks_per_word": "n_marks / n_words",
    "repeated_window_share": "n_repeat_words / n_words",
    "repeated_line_share": "n_dup_lines / n_lines",
    "same_word_share": "n_same_words / n_words",
    "upper_share": "n_upper / word_chars",
    "digit_share": "n_digits / word_chars",
    "chars_per_word": "word_chars / n_words / 40",
}
# Fixed in advance and the same for every rule: from "nothing" to 1 percent.
GRID = tuple(round(0.01 * 1.12**k, 6) for k in range(42, -1, -1))

FALSE_REJECTIONS = 0.08
ERROR_LEVEL = 0.05
# Among certified cutoffs, rejecting a good text weighs as much as missing so many bad ones.
FALSE_COST = 20.0

STATISTICS = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, n_lines long, n_same_words long, n_upper long, n_digits long, n_marks long"
)
UPPER = bytes(range(65, 91))


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a run of ``window`` words that occurs twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    base = np.uint64(0x9E3779B97F4A7C15)
    h = codes.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    held = np.zeros(n, np.uint64)
    for k in range(window):
        held = held * base + h[k : k + n]
    order = np.argsort(held, kind="stable")
    same = held[order][1:] == held[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[: len(codes)] > 0).sum())


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts per text, in one pass without a shuffle."""

    def count(text):
        raw = text.encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        codes = np.array([hash(w) for w in words], np.int64)
        bare = len(raw) - len(raw.translate(None, SPACE))
        gone = lambda chars: len(raw) - len(raw.translate(None, chars))
        return (
            len(words),
            len(text) - bare,
            gone(SYMBOLS),
            len(lines) - len(set(lines)),
            repeated_words(codes),
            len(lines),
            int((codes[1:] == codes[:-1]).sum()),
            gone(UPPER),
            gone(b"0123456789"),
            gone(b"!?"),
        )

    names = [f.split()[0] for f in STATISTICS.split(", ")][2:]

    def step(batches):
        for b in batches:
            rows = [count(t or "") for t in b["text"]]
            yield {"doc_id": b["doc_id"], "lang": b["lang"]} | dict(zip(names, zip(*rows)))

    return map_columns(docs.select("doc_id", "lang", "text"), step, STATISTICS)


def upper_bound(rejected: int, total: int, level: float) -> float:
    """Clopper-Pearson: the largest rate not refuted by ``rejected`` of ``total``."""
    if rejected >= total:
        return 1.0
    low, high = rejected / total, 1.0
    logs = [math.lgamma(total + 1) - math.lgamma(k + 1) - math.lgamma(total - k + 1) for k in range(rejected + 1)]
    for _ in range(60):
        p = (low + high) / 2
        if p <= 0:
            return high
        tail = math.fsum(
            math.exp(c + k * math.log(p) + (total - k) * math.log1p(-p)) for k, c in enumerate(logs)
        )
        low, high = (p, high) if tail > level else (low, p)
    return high


def certified(good: list[int], bad: list[int], n_good: int, n_bad: int, allowed: float, level: float):
    """Grid position of the chosen cutoff, or None.

    ``good`` and ``bad`` count the texts above each cutoff, lenient first.
    """
    best, gain = None, 0.0
    for k, (g, b) in enumerate(zip(good, bad)):
        # More than the allowed share can never pass; this also keeps the sum short.
        if not n_good or g > allowed * n_good or upper_bound(g, n_good, level) > allowed:
            break
        won = b / max(1, n_bad) - FALSE_COST * g / n_good
        if n_bad and won > gain + 1e-12:
            best, gain = k, won
    return best


def ratio(rule: str):
    """The ratio a rule looks at; null where any of its divisors is 0, as in a text without words."""
    return F.expr(reduce(lambda a, b: f"try_divide({a}, {b})", RATIOS[rule].split(" / ")))


def choose_cutoffs(
    statistics: DataFrame,
    labels: DataFrame,
    false_rejections: float = FALSE_REJECTIONS,
    error_level: float = ERROR_LEVEL,
) -> dict[tuple[str, str], float]:
    """``(stratum, rule) -> cutoff`` for the rules that may reject.

    Counting runs on Spark over all labelled rows; strata x rules x grid counts
    reach the driver.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("quality")
    ).where("low = quality").select("doc_id", "quality")
    steps = F.array(*[F.lit(g) for g in sorted(GRID)])
    ratios = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.coalesce(ratio(rule), F.lit(0.0)).alias("ratio"))
            for rule in RATIOS
        ]
    )
    rows = (
        statistics.where(~base_failed()).join(marked, "doc_id")
        .select(F.coalesce("lang", F.lit(NO_VALUE)).alias("stratum"), "quality", F.explode(ratios).alias("r"))
        # How many cutoffs lie below the ratio.
        .select("stratum", "quality", "r.rule", F.size(F.filter(steps, lambda g: g < F.col("r.ratio"))).alias("above"))
        .groupBy("stratum", "rule", "quality", "above")
        .count()
        .collect()
    )
    counts: dict[tuple[str, str], dict[int, np.ndarray]] = {}
    for r in rows:
        by = counts.setdefault((r["stratum"], r["rule"]), {})
        by.setdefault(1 if r["quality"] == 1 else 0, np.zeros(len(GRID) + 1, np.int64))[r["above"]] += r["count"]
    level = error_level / max(1, len(counts))
    empty = np.zeros(len(GRID) + 1, np.int64)
    out = {}
    for key, by in sorted(counts.items()):
        good, bad = by.get(1, empty), by.get(0, empty)
        # Above the cutoff at position k of GRID lie those with more than
        # len(GRID) - 1 - k cutoffs below them.
        over = lambda c: [int(c[len(GRID) - k :].sum()) for k in range(len(GRID))]
        k = certified(over(good), over(bad), int(good.sum()), int(bad.sum()), false_rejections / len(RATIOS), level)
        if k is not None:
            out[key] = GRID[k]
    return out


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    false_rejections: float = FALSE_REJECTIONS,
    error_level: float = ERROR_LEVEL,
) -> DataFrame:
    """Statistics, base check and verdict per text, with the rules that failed."""
    stats = written(text_statistics(docs), "statistics")
    cutoffs = choose_cutoffs(stats, labels, false_rejections, error_level)
    stratum = F.coalesce("lang", F.lit(NO_VALUE))
    fails = [
        F.when((stratum == s) & (ratio(rule) > cut), F.lit(rule))
        for (s, rule), cut in sorted(cutoffs.items())
    ]
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & (F.size(failed) == 0)).alias("kept"),
        failed.alias("failed_rules"),
    )

"""Hard negatives by exact integer inner products, several at a multiplication.

Components become whole numbers. Anchors and candidates are shifted to be at least
zero, and the components of several candidates are laid side by side in separated
fields of one wide number (Kronecker packing): multiplying it by an anchor's component
and adding over the components leaves every candidate's inner product in its own field,
since none can outgrow it. The wide numbers are whole doubles below 2**53, so one matrix
product serves a block of anchors and twice the block's candidates or more. Components
too large for that are cut into digits, whose products are added with their weights.

Anchors are taken in chunks of at most ``ANCHORS``, the stated bound of what is
broadcast; each chunk is compared with all rows where these lie. A task keeps the best
candidates of every search of its chunk and emits them once; Spark merges the tasks'
lists. A first pass finds the positives, a second the negatives in their score bands.

Defined results: a row with a null label, no id, a null or empty vector, or a null or
non-finite component takes no part; rows of different length are never compared; a
component beyond ``LARGEST`` counts as non-finite; rows that share an id are rows of
their own, in the order of where they were written, and an anchor's twin is another
row; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import written

GRID = 256
LARGEST = 2.0**20
ANCHORS = 65_536
ANCHOR_BLOCK = 512
POSITIVES, NEGATIVES = 5, 10
MANTISSA = 53


# --- packed products


class Packing:
    """How components up to ``top`` (and at least zero) share a wide number."""

    def __init__(self, dims: int, top: int):
        # Two fields or more: the digits are as wide as that allows.
        self.digit = min(max(1, int(top).bit_length()), (MANTISSA // 2 - int(dims).bit_length()) // 2)
        if self.digit < 1:
            raise ValueError("vectors are too long")
        self.digits = max(1, -(-int(top).bit_length() // self.digit))
        self.field = (dims * ((1 << self.digit) - 1) ** 2).bit_length()
        self.fields = MANTISSA // self.field

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """Digits of whole numbers, lowest first."""
        mask = (1 << self.digit) - 1
        return [(x >> (k * self.digit)) & mask for k in range(self.digits)]

    def wide(self, x: np.ndarray) -> list[np.ndarray]:
        """Rows laid into fields: row ``f * width + j`` is field ``f`` of number ``j``."""
        width = -(-len(x) // self.fields)
        out = []
        for digit in self.split(x):
            laid = np.zeros((self.fields * width, x.shape[1]), np.int64)
            laid[: len(x)] = digit
            total = np.zeros((width, x.shape[1]), np.int64)
            for f in range(self.fields):
                total += laid[f * width : (f + 1) * width] << (f * self.field)
            out.append(total.T.astype(float))
        return out

    def products(self, anchors: list[np.ndarray], wide: list[np.ndarray], rows: int) -> np.ndarray:
        """Inner products of anchors' digits with packed rows: anchors by rows."""
        mask = (1 << self.field) - 1
        total = None
        for i, a in enumerate(anchors):
            for j, w in enumerate(wide):
                packed = (a @ w).astype(np.int64)
                each = np.concatenate([(packed >> (f * self.field)) & mask for f in range(self.fields)], axis=1)
                each = each[:, :rows] << ((i + j) * self.digit)
                total = each if total is None else total + each
        return total


class Scorer:
    """Exact inner products of one block of anchors with blocks of candidates.

    Both are shifted to be at least zero; what the shift adds is taken off again.
    """

    def __init__(self, anchors: np.ndarray, low: int, high: int):
        self.dims, self.low = anchors.shape[1], low
        self.packing = Packing(self.dims, high - low)
        self.sums = anchors.sum(axis=1) - low * self.dims
        self.digits = [d.astype(float) for d in self.packing.split(anchors - low)]

    def scores(self, rows: np.ndarray, wide) -> np.ndarray:
        shifted = rows.sum(axis=1) - self.low * self.dims
        got = self.packing.products(self.digits, wide, len(rows))
        return got + self.low * (self.sums[:, None] + shifted[None, :]) + self.low * self.low * self.dims


# --- searches


class Searches:
    """The best candidates so far of many searches: at most ``most`` each.

    A search belongs to an anchor and takes rows of its label (or of others) with a
    score in its band. Candidates are ordered by falling score, then id, then place.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.anchor, self.low, self.high, self.same, self.most = anchor, low.copy(), high, same, most
        self.held = [np.zeros(0, np.int64)] * 4  # search, score, id, place

    def offer(self, first: int, scores: np.ndarray, of: np.ndarray, mine, ids, labels, places) -> None:
        """Scores of the searches from ``first`` on: ``of`` names the row of each."""
        part = slice(first, first + len(of))
        s = scores[of]
        fits = (s >= self.low[part, None]) & (s <= self.high[part, None])
        fits &= (labels[None, :] == mine["label"][of][:, None]) == self.same
        fits &= places[None, :] != mine["place"][of][:, None]
        q, c = np.nonzero(fits)
        if not len(q):
            return
        found = [q + first, s[q, c], ids[c], places[c]]
        held = [np.concatenate([a, b]) for a, b in zip(self.held, found)]
        order = np.lexsort((held[3], held[2], -held[1], held[0]))
        search = held[0][order]
        rank = np.arange(len(order)) - np.searchsorted(search, search)
        order = order[rank < self.most]
        self.held = [h[order] for h in held]
        # A full search need not look below its last candidate.
        full = rank[rank < self.most] == self.most - 1
        self.low[self.held[0][full]] = np.maximum(self.low[self.held[0][full]], self.held[1][full])


def _arrays(batch, dims: int):
    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return (x, *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "place")])


def _blocks(rows: int):
    """Growing cuts: the first ones, which find the floors of the searches, are short."""
    at, size = 0, 64
    while at < rows:
        yield at, min(rows, at + size)
        at, size = at + size, min(2 * size, 2_048)


def best(rows: DataFrame, anchors: dict, spec: dict, dims: int, low: int, high: int, same: bool, most: int) -> DataFrame:
    """``search, score, vec_id, place``: the best rows of every search, of each task.

    ``spec`` has ``anchor`` (row in ``anchors``, rising), ``low`` and ``high``.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((anchors, spec))

    def run(batches):
        mine, want = shared.value
        held = []
        for at in range(0, len(mine["vec_id"]), ANCHOR_BLOCK):
            a, z = np.searchsorted(want["anchor"], [at, at + ANCHOR_BLOCK])
            block = {k: v[at : at + ANCHOR_BLOCK] for k, v in mine.items()}
            searches = Searches(want["anchor"][a:z] - at, want["low"][a:z], want["high"][a:z], same, most)
            held.append((a, block, Scorer(block["vec"], low, high), searches))
        for batch in batches:
            vec, ids, labels, places = _arrays(batch, dims)
            for b, e in _blocks(len(vec)):
                wide = held[0][2].packing.wide(vec[b:e] - low) if held else []
                for _, block, scorer, searches in held:
                    if not len(searches.anchor):
                        continue
                    scores = scorer.scores(vec[b:e], wide)
                    # Few searches at once, so that the masks stay small.
                    for k in range(0, len(searches.anchor), ANCHOR_BLOCK):
                        of = searches.anchor[k : k + ANCHOR_BLOCK]
                        searches.offer(k, scores, of, block, ids[b:e], labels[b:e], places[b:e])
        for a, _, _, searches in held:
            search, score, ids, places = searches.held
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (search + a, score, ids, places)], names=["search", "score", "vec_id", "place"]
            )

    found = rows.select("vec", "vec_id", "label", "place").mapInArrow(
        run, "search long, score long, vec_id long, place long"
    )
    order = Window.partitionBy("search").orderBy(F.desc("score"), "vec_id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def entrants(vectors: DataFrame, label) -> DataFrame:
    """``vec_id, label, vec, place``: the rows that take part, with their place.

    They are written first, so a row's place is the same whenever it is read.
    """
    entry = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST)), F.lit(False))
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vec")
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("vec").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", entry)
    )
    rows = rows.select(
        "vec_id",
        label.cast("long").alias("label"),
        F.transform("vec", lambda x: F.floor(x * GRID)).cast("array<long>").alias("vec"),
        F.size("vec").alias("dims"),
    )
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "entrants")


def hard_negatives(
    vectors: DataFrame,
    is_anchor,
    label=None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = 30,
    most: int = 90,
    chunk: int = ANCHORS,
) -> DataFrame:
    """Negatives of each anchor and positive, by falling score.

    ``is_anchor`` is a condition on ``vec_id`` and ``label``. A negative's score, in
    percent of the positive's, lies between ``least`` and ``most``.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = entrants(vectors, F.col("label") if label is None else label)
    out = spark.createDataFrame([], schema)
    sizes = rows.groupBy("dims").agg(
        F.min(F.array_min("vec")).alias("low"),
        F.max(F.array_max("vec")).alias("high"),
        F.sum(is_anchor.cast("long")).alias("anchors"),
    )
    for dims, low, high, count in sizes.where("anchors > 0").orderBy("dims").collect():
        ours = rows.where(F.col("dims") == dims)
        # Dealt by hash; a chunk holds its share or little more.
        chunks = max(1, -(-count * 10 // (chunk * 9)))
        for k in range(chunks):
            here = ours.where(is_anchor & (F.pmod(F.xxhash64("place"), F.lit(chunks)) == k))
            table = here.select("vec", "vec_id", "label", "place").orderBy("place").toArrow()
            if not table.num_rows:
                continue
            vec, ids, labels, places = _arrays(table.combine_chunks().to_batches()[0], dims)
            anchors = {"vec": vec, "vec_id": ids, "label": labels, "place": places}
            every = np.arange(len(ids))
            floor, ceiling = np.full(len(ids), np.iinfo(np.int64).min), np.full(len(ids), np.iinfo(np.int64).max)
            found = best(ours, anchors, {"anchor": every, "low": floor, "high": ceiling}, dims, low, high, True, positives)
            got = written(found, "positives").orderBy("search", "rank").toArrow()
            anchor, score, other = (got.column(c).to_numpy() for c in ("search", "score", "vec_id"))
            # least * p <= 100 * n <= most * p in whole numbers; an empty band if p < 0.
            whole, rest = score // 100, score % 100
            bands = {
                "anchor": anchor,
                "low": least * whole - (-least * rest) // 100,
                "high": most * whole + most * rest // 100,
            }
            found = written(best(ours, anchors, bands, dims, low, high, False, negatives), "negatives")
            pairs = spark.createDataFrame(
                pa.table({"search": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": other, "positive_score": score})
            )
            out = out.unionByName(
                found.join(pairs, "search").select(
                    "anchor_id",
                    "positive_id",
                    "rank",
                    F.col("vec_id").alias("negative_id"),
                    "positive_score",
                    F.col("score").alias("negative_score"),
                )
            )
    return out


def mined_sql() -> str:
    """The rows of the registered query from the plain definition, as SQL."""
    return f"""
    WITH rows_ AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor({GRID} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
               CAST(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 100 = 0
    ), positive AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
    )
    SELECT p.anchor_id, p.positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
           n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
      AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= {NEGATIVES}
    """

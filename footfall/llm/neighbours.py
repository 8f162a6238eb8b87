"""Quality scores by votes of similar labelled texts.

A text becomes a latent-semantic vector: counts of hashed byte trigrams and of a
few repetition terms, as shares drawn towards the sample's mean by the weight of
``PRIOR`` terms (so that short texts are not all noise), as square roots, centred,
scaled and projected on the leading right singular vectors of the sample. The labelled
vectors are broadcast; every text is compared with all of them by exact cosines
in blocks, and the nearest ones vote with a weight that grows with similarity.

The sample is bounded: at most ``per_class`` labelled rows of each class, taken
by a hash of their id, and never from the held-out fold. So the broadcast is at
most ``2 * per_class * latent`` floats. All texts are scored.

Defined results: null and empty texts are scored by the vector of no counts;
without any labelled row every score is 0.5; an id with labels of both kinds is
not learned from; rows with the same id are scored one by one; an empty table
gives an empty table.
"""

from __future__ import annotations

import operator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import held_out, map_columns

TERMS = 2_048
EXTRA = 3
PRIOR = (150.0, 15.0)
# Votes of the base rate, which decide where no neighbour is similar.
BASE_VOTES = 2.0
LATENT = 48
PER_CLASS = 1_500
VOTERS = 21
THRESHOLD = 0.7
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def term_shares(text: str | None) -> np.ndarray:
    """Shares of hashed trigrams and of repetition terms, then the numbers of
    trigrams and of words they are shares of."""
    out = np.zeros(TERMS + EXTRA + 2, np.float32)
    raw = (text or "").encode()
    if len(raw) >= 3:
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
        code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(21)
        out[:TERMS] = np.bincount(code, minlength=TERMS) / len(code)
        out[-2] = len(code)
    words = raw.split()
    if words:
        lines = [x for x in raw.split(b"\n") if x.strip()]
        out[TERMS] = sum(map(operator.eq, words, words[1:])) / len(words)
        out[TERMS + 1] = 1 - len(set(lines)) / max(1, len(lines))
        out[TERMS + 2] = sum(map(bytes.isupper, words)) / len(words)
        out[-1] = len(words)
    return out


def _features(docs: DataFrame) -> DataFrame:
    def step(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "shares": [term_shares(t).tobytes() for t in b["text"]]}

    return map_columns(docs.select("doc_id", "text"), step, "doc_id long, shares binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """Term shares and labels of the bounded sample, at most ``2 * per_class`` rows,
    and the share of label 1 among all labelled rows outside the held-out fold."""
    marked = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
        .where("low = quality")
    )
    chosen = None
    for kind in (0, 1):
        part = marked.where(F.col("quality") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select("doc_id", "quality")
    # Bounded by the limits above, hence safe to broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = (
        _features(texts).groupBy("doc_id").agg(F.min("shares").alias("shares")).join(F.broadcast(chosen), "doc_id")
        .orderBy("doc_id")
        .collect()
    )
    shares = np.array([np.frombuffer(r["shares"], np.float32) for r in rows]).reshape(len(rows), TERMS + EXTRA + 2)
    rate = marked.agg(F.avg("quality")).first()[0]
    return shares, np.array([r["quality"] for r in rows], float), rate


class Latent:
    """Centring, scaling and projection learned from the sample."""

    def __init__(self, shares: np.ndarray, latent: int = LATENT):
        self.prior = shares[:, :-2].mean(axis=0)
        shares = self.drawn(shares)
        self.mean = shares.mean(axis=0)
        spread = shares.std(axis=0)
        self.scale = 1 / (spread + np.float32(0.01))
        self.scale[TERMS:] *= 20
        held = (shares - self.mean) * self.scale
        # Randomised range finder with power iterations, fixed seed.
        width = min(latent + 16, *held.shape)
        q = np.linalg.qr(held.T @ np.random.default_rng(7).standard_normal((len(held), width)).astype(np.float32))[0]
        for _ in range(4):
            q = np.linalg.qr(held.T @ (held @ q))[0]
        rotate = np.linalg.svd(held @ q, full_matrices=False)[2]
        self.axes = (q @ rotate.T)[:, :latent].astype(np.float32)

    def drawn(self, shares: np.ndarray) -> np.ndarray:
        """Square roots of the shares after adding the prior's terms."""
        n = np.repeat(shares[:, -2:], (TERMS, EXTRA), axis=1)
        weight = np.repeat(np.array(PRIOR, np.float32), (TERMS, EXTRA))
        return np.sqrt((shares[:, :-2] * n + self.prior * weight) / (n + weight))

    def vectors(self, shares: np.ndarray) -> np.ndarray:
        v = ((self.drawn(shares) - self.mean) * self.scale) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def votes(
    vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, rate: float, voters: int = VOTERS
) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled vectors,
    with ``BASE_VOTES`` votes for the base rate."""
    near = vectors @ known.T
    k = min(voters, len(known))
    top = np.argpartition(near, len(known) - k, axis=1)[:, len(known) - k :]
    weight = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float) ** 4
    return ((weight * labels[top]).sum(axis=1) + BASE_VOTES * rate) / (weight.sum(axis=1) + BASE_VOTES)


def _voters(docs: DataFrame, labels: DataFrame, per_class: int):
    """Model, labelled vectors, labels and base rate; None without labelled rows."""
    shares, marks, rate = labelled_sample(docs, labels, per_class)
    if not len(marks):
        return None
    model = Latent(shares)
    return model, model.vectors(shares), marks, rate


def kept_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, voters: int = VOTERS) -> DataFrame:
    """The rows whose score reaches ``THRESHOLD``, all columns unchanged.

    Without any labelled row nothing is rejected.
    """
    found = _voters(docs, labels, per_class)
    if found is None:
        return docs
    # Pickled by value, so that executors need no copy of this package.
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(found))

    def step(batches):
        model, known, marks, rate = cloudpickle.loads(held.value)
        for b in batches:
            score = votes(model.vectors(np.array([term_shares(t) for t in b["text"]])), known, marks, rate, voters)
            on = np.flatnonzero(score >= THRESHOLD).tolist()
            yield {k: [v[i] for i in on] for k, v in b.items()}

    return map_columns(docs, step, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes))


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, voters: int = VOTERS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every text."""
    found = _voters(docs, labels, per_class)
    if found is None:
        return docs.select(
            "doc_id", held_out().alias("held_out"), F.lit(0.5).alias("score"), F.lit(0).alias("predicted")
        )
    # Pickled by value, so that executors need no copy of this package.
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(found))

    def step(batches):
        model, known, marks, rate = cloudpickle.loads(held.value)
        for b in batches:
            found = votes(model.vectors(np.array([term_shares(t) for t in b["text"]])), known, marks, rate, voters)
            yield {
                "doc_id": b["doc_id"],
                "held_out": b["held_out"],
                "score": np.clip(found, 0, 1),
                "predicted": (found >= THRESHOLD).astype(np.int32),
            }

    return map_columns(docs.select("doc_id", "text", held_out().alias("held_out")), step, SCORES)

"""SimHash near-duplicates through a table of distances to reference fingerprints.

The references are zero, the 64 fingerprints with one bit, and seven random ones.
Relative to zero, the distances to the one-bit references of a block spell out
that block's bits, so two fingerprints within 4 bits agree on at least two of six
blocks of those coordinates: that is the equi-join. Distances to the random
references are stored with every fingerprint; a pair whose largest coordinate
difference exceeds the limit cannot be near (triangle inequality) and is dropped,
survivors are verified bit by bit.

Equal fingerprints are merged first. A dense group never emits its pairs: links
between neighbours in sorted order join most of it, and then only pairs across
components are sought, each with a side outside the main component of its bucket.

Defined results: null and empty texts have fingerprint zero and link like any
other; rows without an id have a fingerprint but no component and link nothing;
rows that share an id are one node; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import connected, map_columns, written

BLOCKS = (11, 11, 11, 11, 10, 10)
SEED = 42
CHAIN = 4


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the lower-cased word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends)], "<u8")
    # Set bits per position, a bounded number of shingles at a time.
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8_192):
        bits = np.unpackbits(hashes[at : at + 8_192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` for every row, in one pass without a shuffle."""

    def step(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [fingerprint(t, shingle) for t in b["text"]]}

    return map_columns(docs.select("doc_id", "text"), step, "doc_id long, fp long")


def references() -> list[int]:
    """The random reference fingerprints, as signed numbers."""
    return [int(x) for x in np.random.default_rng(SEED).integers(-(2**63), 2**63 - 1, 7)]


def pivot_table(df: DataFrame) -> DataFrame:
    """Add the distances to the random references, eight bits each, as ``pivots``."""
    packed = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * i) for i, r in enumerate(references())]
    return df.withColumn("pivots", reduce(lambda a, b: a.bitwiseOR(b), packed))


def block_masks(most: int) -> list[int]:
    """Masks of the block pairs on which fingerprints within ``most`` bits agree."""
    if most > 4:
        raise ValueError("six blocks guarantee two equal ones up to four differing bits")
    starts = np.r_[0, np.cumsum(BLOCKS)[:-1]]
    one = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, starts)]
    both = [a | b for a, b in combinations(one, 2)]
    return [m - 2**64 if m >= 2**63 else m for m in both]


def _buckets(table: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(
        *[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
    )
    return table.withColumn("key", F.explode(keys)).select("key.part", "key.bits", *table.columns)


def _near(a: str, b: str, most: int):
    """Coordinate filter, then verification."""
    def place(side, i):
        return F.shiftright(F.col(f"{side}.pivots"), 8 * i).bitwiseAND(F.lit(255))

    apart = [F.abs(place(a, i) - place(b, i)) <= most for i in range(len(references()))]
    exact = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= most
    return reduce(lambda x, y: x & y, apart) & exact


def _chains(buckets: DataFrame, most: int) -> DataFrame:
    """Links between fingerprints that stand close in the sorted buckets.

    Range partitions of (bucket, fingerprint): a large bucket spans several tasks.
    """
    def step(batches):
        held = None
        for b in batches:
            now = [np.array(b[k], np.int64) for k in ("part", "bits", "fp", "node")]
            if held is not None:
                now = [np.r_[h, n] for h, n in zip(held, now)]
            part, bits, fp, node = now
            us, vs = [], []
            linked = np.zeros(len(fp), bool)
            for k in range(1, min(CHAIN, len(fp) - 1) + 1):
                same = (part[k:] == part[:-k]) & (bits[k:] == bits[:-k]) & ~linked[k:]
                near = same & (np.bitwise_count((fp[k:] ^ fp[:-k]).view(np.uint64)) <= most)
                us.append(node[:-k][near])
                vs.append(node[k:][near])
                linked[k:] |= near
            held = [n[-CHAIN:] for n in now]
            if us:
                yield {"u": np.concatenate(us), "v": np.concatenate(vs)}

    rows = buckets.repartitionByRange("part", "bits", "fp").sortWithinPartitions("part", "bits", "fp")
    return map_columns(rows.select("part", "bits", "fp", "node"), step, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over near pairs."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    table = written(
        pivot_table(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))), "pivots"
    )
    # An id on several rows may stand for several fingerprints.
    shared = (
        marked.where("doc_id is not null").distinct().join(table.select("fp", "node"), "fp")
        .where("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    )
    repeated = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    shared = shared.join(repeated.select(F.col("doc_id").alias("v")), "v", "left_semi").select("u", "v")
    masks = block_masks(most)
    buckets = _buckets(table, masks)
    first = connected(_chains(buckets, most).unionByName(shared), "near-first")
    named = written(
        table.join(first.withColumnRenamed("component_id", "label"), "node", "left").withColumn(
            "label", F.coalesce("label", "node")
        ),
        "near-named",
    )
    rows = _buckets(named, masks)
    # The label most rows of a bucket carry; only other rows look for partners.
    main = (
        rows.groupBy("part", "bits", "label").count()
        .groupBy("part", "bits").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels"))
        .where("labels > 1").drop("labels")
    )
    seekers = rows.join(main, ["part", "bits"]).where("label <> main").alias("a")
    across = (
        seekers.join(rows.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") == F.col("b.bits"))
                     & (F.col("a.label") != F.col("b.label")) & _near("a", "b", most))
        .select(F.col("a.label").alias("u"), F.col("b.label").alias("v")).distinct()
    )
    second = connected(across, "near-across").withColumnRenamed("node", "label")
    final = named.join(second, "label", "left").select("fp", F.coalesce("component_id", "label").alias("component_id"))
    out = marked.join(final, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))

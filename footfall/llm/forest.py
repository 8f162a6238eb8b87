"""Near-duplicate vectors by a forest of random-projection trees.

Every node projects its vectors on a random direction and cuts at the median;
vectors close to the cut go to both sides (spill). Cuts come from a sample of at
most ``FIT_ROWS`` vectors per node; every vector is then routed. Nodes above the
leaf size are cut again in the next round, so leaves stay bounded at any input
size. Vectors are compared exactly, in double precision, within the leaves.

Dense groups are not cut. Where sampled vectors have more near partners than a leaf
holds, some become centres. Vectors near a centre (its core) leave the node and form
one set with all vectors within twice the angle, hence with all their partners in the
node. This is done once over all vectors, before there are trees, and again in every
node. Sets and leaves above ``WIDE`` rows are compared block against block, in up to as many
tasks as there are pairs of blocks: the cost is quadratic in the size of such a group.

A pair that meets in several leaves counts only in the smallest one they share,
so leaves emit counts and a spanning forest instead of pairs, and results do not
depend on which leaf is read first. Equal vectors are merged beforehand.

Defined results: a vector that is null, zero, empty or holds a null or non-finite
component links with nothing; vectors of different length do not link; rows
without an id link with nothing and have no component; rows that share an id
count as separate vectors; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import connected, map_columns, written

TREES = 8
LEAF = 1_024
SPILL = 0.06
FIT_ROWS = 4_096
DEPTH = 6
SEED = 11
BLOCK = 512
# Rows of a block of a large leaf; every row is sent once per block of its leaf.
WIDE = 4_096
# Near partners in the sample that make a vector a centre; most centres of a node.
LEAST_SEEN = 8
SETS = 8_192

NODE = "tree int, dim int, path long"


def direction(tree: int, dim: int, path: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree, dim, path]).standard_normal(dim)


def _matrix(blobs, kind) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_cuts(x: np.ndarray, tree: int, dim: int, path: int, rows: int, leaf: int, spill: float):
    """Nodes below ``path`` as (path, low, high): right of ``low`` and left of ``high``."""
    out, todo = [], [(path, np.arange(len(x)), 0)]
    while todo:
        at, members, depth = todo.pop()
        if depth == DEPTH or len(members) * rows <= leaf * len(x) or len(members) < 8:
            continue
        p = x[members] @ direction(tree, dim, at)
        low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
        left, right = members[p <= high], members[p >= low]
        if max(len(left), len(right)) == len(members):
            continue
        out.append((at, float(low), float(high)))
        todo += [(2 * at, left, depth + 1), (2 * at + 1, right, depth + 1)]
    return out


def dense_centres(x: np.ndarray, rows: int, leaf: int, least: float) -> np.ndarray:
    """Sampled vectors such that every one with over ``leaf`` near partners is near one."""
    near = x @ x.T >= least
    partners = near.sum(axis=1) - 1
    open_ = (partners >= LEAST_SEEN) & (partners * rows > leaf * len(x))
    chosen = []
    while open_.any():
        c = int(np.argmax(np.where(open_, partners, -1)))
        chosen.append(c)
        open_ &= ~near[c]
        open_[c] = False
    return x[chosen]


def dense_sets(x: np.ndarray, centres: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The rows around each centre, and those in no core, which go on."""
    if not len(centres):
        return [], np.arange(len(x))
    cosine = x @ centres.T
    # A partner of a core vector is within twice the angle; a little more for rounding.
    around = cosine >= np.cos(min(np.pi, 2 * np.arccos(np.clip(least, -1, 1)))) - 1e-9
    return [np.flatnonzero(a) for a in around.T], np.flatnonzero(~(cosine >= least).any(axis=1))


def route(x: np.ndarray, tree: int, dim: int, path: int, cuts: dict) -> list[tuple[int, np.ndarray]]:
    """Leaves reached and the rows that reach them."""
    out, todo = [], [(path, np.arange(len(x)))]
    while todo:
        at, members = todo.pop()
        if at not in cuts:
            out.append((at, members))
            continue
        low, high = cuts[at]
        p = x[members] @ direction(tree, dim, at)
        todo += [(2 * at, members[p <= high]), (2 * at + 1, members[p >= low])]
    return [(at, m) for at, m in out if len(m)]


def grown(vectors: DataFrame, kind: str, trees: int, leaf: int, spill: float, least: float) -> DataFrame:
    """``tree, dim, path, rep, n, vec``: every vector in all the leaves it reaches.

    Sets around centres have negative paths, and tree -1 if they are of all vectors.
    """
    key = ["tree", "dim", "path"]
    columns = [*key, "rep", "n", "vec"]

    def split(rows: DataFrame, counts: DataFrame, cut: bool):
        share = F.lit(FIT_ROWS) / F.col("rows") * 1_000_000
        sample = rows.join(counts, key).where(F.pmod(F.xxhash64("rep", "tree", "path"), F.lit(1_000_000)) < share)

        def fit(group):
            tree, dim, path, n = (int(group[c].iloc[0]) for c in (*key, "rows"))
            x = _matrix(list(group["vec"]), kind)
            centres = dense_centres(x, n, leaf, least)
            rest = x[dense_sets(x, centres, least)[1]]
            left = -(-n * len(rest) // len(x))
            cuts = fit_cuts(rest, tree, dim, path, left, leaf, spill) if cut else []
            import pandas as pd

            return pd.DataFrame(
                {
                    "tree": [tree], "dim": [dim], "path": [path], "centres": [centres.tobytes()],
                    "at": [[c[0] for c in cuts]], "low": [[c[1] for c in cuts]], "high": [[c[2] for c in cuts]],
                }
            )

        cuts = written(
            sample.groupBy(*key).applyInPandas(
                fit, NODE + ", centres binary, at array<long>, low array<double>, high array<double>"
            ),
            "cuts",
        )

        def send(batches):
            for b in batches:
                out = {k: [] for k in columns}
                nodes: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(b["tree"], b["dim"], b["path"])):
                    nodes.setdefault(k, []).append(i)
                for (tree, dim, path), idx in nodes.items():
                    at, low, high = (b[c][idx[0]] for c in ("at", "low", "high"))
                    known = dict(zip(at, zip(low, high)))
                    x = _matrix([b["vec"][i] for i in idx], kind)
                    sets, rest = dense_sets(x, np.frombuffer(b["centres"][idx[0]]).reshape(-1, dim), least)
                    to_rows = [(-path * SETS - j, m) for j, m in enumerate(sets)]
                    to_rows += [(to, rest[m]) for to, m in route(x[rest], tree, dim, path, known)] if len(rest) else []
                    for to, members in to_rows:
                        for m in members.tolist():
                            for c, v in (("tree", tree), ("dim", dim), ("path", to)):
                                out[c].append(v)
                            for c in ("rep", "n", "vec"):
                                out[c].append(b[c][idx[m]])
                yield out

        return cuts, written(
            map_columns(rows.join(cuts, key), send, NODE + ", rep long, n long, vec binary"), "routed"
        )

    def large(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 2 * leaf), "nodes")

    whole = vectors.select(F.lit(-1).alias("tree"), "dim", F.lit(1).cast("long").alias("path"), "rep", "n", "vec")
    counts, done = large(whole), None
    if counts.head(1):
        _, routed = split(whole, counts, False)
        done = routed.where("path < 0")
        whole = routed.where("path > 0").unionByName(whole.join(counts.select(*key), key, "left_anti").select(*columns))
    rows = whole.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in range(trees)]))).select(*columns)
    for _ in range(40):
        counts = large(rows)
        if not counts.head(1):
            break
        cuts, routed = split(rows, counts, True)
        # A node that could not be cut stays a leaf; its blocks are still compared.
        stuck = cuts.where("size(at) = 0").select(*key)
        for more in (
            rows.join(counts.select(*key), key, "left_anti"),
            routed.where("path < 0"),
            routed.where("path > 0").join(stuck, key, "left_semi"),
        ):
            done = more.select(*columns) if done is None else done.unionByName(more.select(*columns))
        rows = routed.where("path > 0").join(stuck, key, "left_anti").select(*columns)
    return rows if done is None else done.unionByName(rows)


def joined(label, i, j):
    """``label``, which gives every row the smallest row of its set, after linking rows i and j."""
    while True:
        u, v = label[i], label[j]
        apart = u != v
        if not apart.any():
            return label
        i, j, u, v = i[apart], j[apart], u[apart], v[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]


def leaf_links(rep, weight, x, leaves, here: int, least: float, side=None):
    """Weighted links of each vector and the smallest row it is linked to, from owned pairs.

    ``leaves`` holds the codes of all leaves of every row, padded with -1. With a
    sorted ``side``, only pairs of different sides are compared. Links are merged block
    by block, so no pair is kept.
    """
    n = len(rep)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            if side is not None and side[a] == side[min(b + BLOCK, n) - 1]:
                continue
            i, j = np.nonzero(x[a : a + BLOCK] @ x[b : b + BLOCK].T >= least)
            i, j = i + a, j + b
            ok = i < j if side is None else (i < j) & (side[i] != side[j])
            i, j = i[ok], j[ok]
            label = joined(label, i, j)
            for k in range(0, len(i), 20_000):
                p, q = i[k : k + 20_000], j[k : k + 20_000]
                # Rows in one leaf only can meet nowhere else.
                if leaves.shape[1] > 1:
                    shared = (leaves[p][:, :, None] == leaves[q][:, None, :]) & (leaves[p] >= 0)[:, :, None]
                    first = np.where(shared.any(axis=2), leaves[p], np.iinfo(np.int64).max).min(axis=1)
                    p, q = p[first == here], q[first == here]
                for one, other in ((p, q), (q, p)):
                    links += np.bincount(one, weight[other], n).astype(np.int64)
    return links, label


def near_vectors(
    vectors: DataFrame, least: float = 0.9, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, wide: int = WIDE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    held = dict(vectors.dtypes)["embedding"]
    kind = "<f4" if held == "array<float>" else "<f8"
    value = F.col("embedding") if held in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    valid = F.coalesce(
        (F.size(value) > 0)
        & ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(value, lambda v: v != 0),
        F.lit(False),
    )
    marked = vectors.select(
        "vec_id",
        value.alias("embedding"),
        (valid & F.col("vec_id").isNotNull()).alias("valid"),
        F.xxhash64("embedding").alias("k1"),
        F.xxhash64(F.lit(SEED), "embedding").alias("k2"),
    )
    classes = (
        marked.where("valid").groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    )

    def pack(batches):
        for b in batches:
            yield {
                "k1": b["k1"], "k2": b["k2"], "rep": b["rep"], "n": b["n"],
                "dim": [len(e) for e in b["embedding"]],
                "vec": [np.array(e, kind).tobytes() for e in b["embedding"]],
            }

    classes = written(map_columns(classes, pack, "k1 long, k2 long, rep long, n long, dim int, vec binary"), "classes")
    # Different vectors may share an id: all but one of them get a name from their hash, and
    # sets that hold such names are named after the smallest id in the end.
    shared = written(
        classes.groupBy("rep").agg(F.count("*").alias("classes"), F.min(F.struct("k1", "k2")).alias("first"))
        .where("classes > 1").select("rep", "first"),
        "shared-ids",
    )
    own = F.col("first").isNull() | (F.struct("k1", "k2") == F.col("first"))
    name = F.xxhash64("k1", "k2").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    classes = classes.join(shared, "rep", "left").select(
        "k1", "k2", F.when(own, F.col("rep")).otherwise(name).alias("rep"), F.col("rep").alias("id"), "n", "dim", "vec"
    )
    code = F.xxhash64("tree", "dim", "path").bitwiseAND(F.lit(2**62 - 1)).alias("leaf")
    leaves = written(grown(classes, kind, trees, leaf, spill, least).select(code, "dim", "rep", "n", "vec"), "leaves")
    reached = leaves.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    # Large leaves in blocks of about ``wide`` rows: a row goes to every pair of its block.
    wide = max(leaf, wide)
    # A number of its own, since adaptive execution would put these small rows into few tasks.
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / wide).cast("int").alias("blocks")).where("blocks > 1")
    cell = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("a"), F.greatest(o, F.col("block")).alias("b")),
    )
    together = (
        leaves.join(reached, "rep").join(sizes, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("cell", F.explode(cell)).select("leaf", "cell.a", "cell.b", "block", "rep", "n", "vec", "leaves")
        .repartition(tasks, "leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "block", "rep")
    )

    def compare(batches):
        held_rows, code_now = [], None

        def result():
            if len(held_rows) < 2:
                return None
            block, rep, n, vec, own = zip(*held_rows)
            side = None if code_now[1] == code_now[2] else np.array(block)
            wide = max(map(len, own))
            padded = np.array([list(o) + [-1] * (wide - len(o)) for o in own], np.int64)
            rep = np.array(rep, np.int64)
            links, label = leaf_links(rep, np.array(n, np.int64), _matrix(vec, kind), padded, code_now[0], least, side)
            some = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
            return {"rep": rep[some], "links": links[some], "u": rep[label[some]]}

        for b in batches:
            for row in zip(*(b[c] for c in ("leaf", "a", "b", "block", "rep", "n", "vec", "leaves"))):
                if row[:3] != code_now:
                    if (out := result()) is not None:
                        yield out
                    held_rows, code_now = [], row[:3]
                held_rows.append(row[3:])
        if (out := result()) is not None:
            yield out

    found = written(map_columns(together, compare, "rep long, links long, u long"), "links")
    parts = connected(found.select("u", F.col("rep").alias("v")), "forest").withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    renamed = (
        parts.join(classes.where("rep <> id").select("rep", "id"), "rep")
        .groupBy("component_id").agg(F.min("id").alias("least_id"))
    )
    known = (
        classes.select("k1", "k2", "rep", "id", "n").join(links, "rep", "left").join(parts, "rep", "left")
        .join(renamed, "component_id", "left")
        .select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce(F.least("component_id", "least_id"), "id").alias("component_id"), F.lit(True).alias("valid"))
    )
    component = F.coalesce("component_id", "vec_id")
    return marked.select("vec_id", "valid", "k1", "k2").join(known, ["k1", "k2", "valid"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

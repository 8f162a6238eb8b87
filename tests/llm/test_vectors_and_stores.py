"""Hard negatives, the id store and whitening against plain computations and on odd rows."""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from footfall.llm import idstore, negatives, queries, whitening
from footfall.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
VECTOR = "vec_id long, embedding array<float>, label int, vec string, place long, n int, dims int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1, 2, 3) for i, v, k in rows], VECTOR).repartition(3)


def odd_vectors(rng, dims=5, many=400):
    rows = [(i, [float(x) for x in rng.standard_normal(dims)], int(rng.integers(0, 4))) for i in range(many)]
    rows += [(i, rows[i % 40][1], rows[i % 40][2]) for i in range(many, many + 60)]  # ties
    rows += [(500, None, 1), (600, [], 1), (700, [1.0, None, 2.0, 0.0, 0.0], 1), (800, [NAN] * dims, 1)]
    rows += [(900, [INF] + [0.0] * (dims - 1), 1), (1000, [0.5] * dims, None), (None, [0.5] * dims, 1)]
    rows += [(1100, [0.0] * dims, 1), (1200, [0.5] * (dims + 2), 1), (1400, [-0.25] * dims, 2)]
    return rows


# 11: hard negatives


def plain_negatives(rows, anchor, label):
    rows = [
        (i, np.floor(256 * np.array(v, float)).astype(object), label(i, k))
        for i, v, k in rows
        if None not in (i, v, k) and len(v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = Counter()
    for at, (i, v, k) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted(
            (-int((v * w).sum()), j, p, m) for p, (j, w, m) in enumerate(rows) if p != at and len(w) == len(v)
        )
        for s, j, _, _ in [r for r in scored if r[3] == k][:5]:
            fit = [r for r in scored if r[3] != k and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out.update((i, j, n, r[1], -s, -r[0]) for n, r in enumerate(fit, 1))
    return out


def mined(df, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label, **how).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in names) for r in got)


@pytest.mark.parametrize("scale", [0.3, 1.0, 3000.0])
def test_negatives_match_plain_scores(spark, scale):
    rows = [
        (i, v and [x if x is None else float(np.float32(x * scale)) for x in v], k)
        for i, v, k in odd_vectors(np.random.default_rng(2))
    ]
    want = plain_negatives(rows, lambda i: i % 100 == 0, lambda i, k: (k + 1) % 10 if i % 7 == 0 else k)
    df = vectors(spark, rows)
    assert len(want) > 50 and mined(df) == want
    assert mined(df, chunk=2) == want  # several chunks of anchors


def test_negatives_of_repeated_rows_and_no_rows(spark):
    one = (100, [1.0, 0.0], 3)
    df = vectors(spark, [one, one, (1, [0.9, 0.1], 3), (2, [0.5, 0.5], 4), (3, [0.8, 0.0], 4)])
    got = mined(df)
    # Both twins are anchors, and each is the other's first positive.
    assert got[(100, 100, 1, 3, 65536, 52224)] == 2 and got[(100, 1, 1, 3, 58880, 52224)] == 2
    assert mined(df.limit(0)) == Counter()
    assert mined(vectors(spark, [one])) == Counter()


def test_packed_products_are_exact():
    rng = np.random.default_rng(5)
    for dims, low, high in [(64, -200, 200), (3, 0, 1), (1, -5, -5), (300, -(2**20), 2**20), (8, -(2**27), 2**27)]:
        a, c = rng.integers(low, high + 1, (7, dims)), rng.integers(low, high + 1, (13, dims))
        a[0], c[0], c[1] = low, low, high
        scorer = negatives.Scorer(a, low, high)
        assert scorer.packing.fields >= 2
        assert (scorer.scores(c, scorer.packing.wide(c - low)) == a @ c.T).all()


# 12: the id store

TEXTS = [
    None, "", " ", "it's a test, isn't it? 'S 's\n'tis 'll", "a  b   c \n d\t\te\r\n", "<|endoftext|> x<|endoftext|>",
    "Ünï cödé naïve œuvre", "Привет, мир! 123-456", "日本語 テキスト 🙂🙂", "x_y __z__ a_b's", "\x1c\x1d a\x1eb", "½ ² Ⅷ ① ª",
    "é ö'll", "…“quoted” – dash—", "word " * 3000, "x" * 5000, "“don’t”", " lead", "trail ", " nbsp  em",
]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_ids_of_words_equal_whole_ids(monkeypatch):
    rng = np.random.default_rng(3)
    signs = list("aZ09 '’_.,!-\n\t\r  ") + ["'s", "'ll", "é", "Ж", "ß", "́", "½", "ª", " ", "\x85", " ", "–", "語", "\x1f", "　"]
    texts = TEXTS + ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(4000)]
    texts += ["a" + chr(c) + "b 's " + chr(c) + "'t " + chr(c) * 2 for c in range(1, 0x600)]
    coder = idstore.ByteIds(TOKENIZER)
    got = [np.frombuffer(x, coder.kind).tolist() for x in coder.packed(pa.array(texts, pa.large_string()))]
    assert got == [ids[:-1] for ids in plain_ids(texts)]
    monkeypatch.setattr(idstore, "CACHED_BYTES", 10)  # forgets before every batch
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.packed(pa.array(texts[:20], pa.large_string()))] == got[:20]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, ids string, copy int, start int")


def test_store_round_trip(spark, monkeypatch):
    rows = [(7 * k % 23 - 5, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (None, "no id"), (3, "again"), (3, "again")]
    rows += [(50, f"hot {k % 3}") for k in range(300)]
    folder = scratch_path(spark, "store-test")
    monkeypatch.setattr(idstore, "OUT_BYTES", 900)
    # Small shards and buckets: the hot id spreads over many of both.
    got = idstore.token_file_digests(documents(spark, rows).repartition(5), TOKENIZER, folder, shard_bytes=200, keys=20).collect()
    about = idstore.read_manifest(folder)
    assert about["buckets"] > 5 and about["shards"] > 8 and about["documents"] == len(rows)
    ids = plain_ids([t for _, t in rows])
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    # Places follow each other without gaps in ascending order of ids, nulls first.
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    copies = defaultdict(list)
    for r in got:
        copies[r.doc_id].append(r.copy)
    assert all(c == list(range(len(c))) for c in copies.values())
    # Single keys, and keys that are not there.
    reader = idstore.Reader(folder)
    for r in got[::17]:
        assert zlib.crc32(reader.get(r.doc_id, r.copy).tobytes()) == r.ids_crc32
    assert reader.get(10**12) is None and reader.get(3, 99) is None and reader.get(None, 2) is None
    asked = spark.createDataFrame([(3, 0), (3, 99), (-77, 0), (None, 1)], "doc_id long, copy long")
    found = idstore.fetched(spark, folder, asked).collect()
    assert {(r.doc_id, r.copy) for r in found} == {(3, 0), (None, 1)}


def test_store_of_nothing(spark):
    folder = scratch_path(spark, "store-test")
    assert idstore.token_file_digests(documents(spark, []), TOKENIZER, folder).count() == 0
    assert idstore.Reader(folder).get(1) is None


def test_hash_index_is_minimal_and_perfect():
    for n in (0, 1, 2, 1000, 100_000):
        hashes = idstore.key_hashes(np.arange(n) * 3 - n, np.zeros(n, bool), np.arange(n) % 5)
        records = np.zeros(n, idstore.RECORD)
        records["print"], records["n"] = hashes[2], np.arange(n)
        index, table = idstore.index_parts(idstore.index_file(hashes, records))
        slots = index.slots(hashes)
        assert sorted(slots.tolist()) == list(range(n)) and (table[slots]["n"] == np.arange(n)).all()
        other = idstore.key_hashes(np.arange(5000) + 10**9, np.zeros(5000, bool), np.zeros(5000, int))
        at = index.slots(other)
        assert not ((at >= 0) & (table[np.maximum(at, 0)]["print"] == other[2])).any() if n else (at < 0).all()
        assert sum(index.sizes) <= 6 * n + 64 * 64
    with pytest.raises(ValueError):
        idstore.HashIndex.build(hashes[:, [1, 1]])


def test_a_second_attempt_writes_the_same_file(spark):
    folder = scratch_path(spark, "store-test")
    for _ in range(2):
        f = idstore._NewFile(folder, "manifest.json")
        f.write(json.dumps({"a": 1}).encode())
        f.close()
    fs, root = idstore.opened(folder)
    import pyarrow.fs as pafs

    assert [x.base_name for x in fs.get_file_info(pafs.FileSelector(root))] == ["manifest.json"]
    assert idstore.read_manifest(folder) == {"a": 1}


# 13: whitening


def same_eigen(a):
    values, axes = whitening.eigen(a)
    scale = np.linalg.norm(a) or 1.0
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ axes - axes * values).max() < 1e-13 * scale


def test_eigenvectors_by_polar_factors():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    spectra = [
        np.ones(24), np.zeros(24), np.repeat([1.0, 2, 3], 8), 10.0 ** -np.arange(24), np.linspace(-1, 1, 24),
        np.r_[np.zeros(20), np.arange(4)], 1 + 1e-13 * np.arange(24), np.r_[1e9, np.ones(23)],
    ]
    for s in spectra:
        same_eigen((q * s) @ q.T)
    for a in (np.eye(5), np.zeros((3, 3)), np.ones((7, 7)), np.diag([3.0, 1, 2]), np.array([[4.0]])):
        same_eigen(a)
    u = whitening.polar((q * np.linspace(-2, 3, 24)) @ q.T)
    assert np.abs(u - (q * np.sign(np.linspace(-2, 3, 24))) @ q.T).max() < 1e-13


def plain_whitened(rows):
    rows = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    keep = np.argsort(-values)[:32]
    w = c @ axes[:, keep] / np.sqrt(values[keep])
    return rows, [int(sum(int(v) ** 2 for v in row)) for row in n * x - s], w, values[keep] / values.sum()


def test_whitening_matches_a_plain_one(spark):
    rows = [(i, v) for i, v, _ in odd_vectors(np.random.default_rng(6)) if i != 1200]
    df = vectors(spark, [(i, v, 0) for i, v in rows] + [(1200, [0.5] * 7, 0), (1201, [3e30] * 5, 0)])
    kept, deviation, w, explained = plain_whitened(rows)
    got = defaultdict(list)
    for r in whitening.whitened(df).orderBy("component").collect():
        got[(r.vec_id, r.deviation)].append(r)
    assert sum(map(len, got.values())) == 5 * len(kept)
    signs = None
    for (i, _), d, row in sorted(zip(kept, deviation, w), key=lambda r: -np.abs(r[2]).min()):
        mine = got[(i, d)][:: len(got[(i, d)]) // 5]
        assert [r.component for r in mine] == [1, 2, 3, 4, 5] and {r.n for r in mine} == {len(kept)}
        values = np.array([r.whitened for r in mine])
        signs = np.sign(values * row) if signs is None else signs
        assert np.abs(values * signs - row).max() < 1e-9
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert max(r.identity_error for r in mine) < 1e-9


def test_whitening_of_degenerate_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(50)]
    got = whitening.whitened(vectors(spark, flat)).collect()
    # One direction only: two components have no spread and are left out.
    assert len(got) == 50 and {r.component for r in got} == {1} and max(r.identity_error for r in got) < 1e-9
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5, [(1, None, 0)]):
        assert whitening.whitened(vectors(spark, rows)).count() == 0


def test_deviation_beyond_a_long_is_null():
    big = np.array([[2**33, 1], [3, 4]])
    assert whitening.deviations(big) == [None, 25]
    assert whitening.deviations(big.astype(object)) == [None, 25]


@pytest.mark.parametrize("name, rows", [("op12_id_store", 200), ("op13_whitening", 500 * 32)])
def test_registered_queries(spark, name, rows):
    got = queries.QUERIES[name](spark, SF_SMALL)
    assert got.count() == rows

"""Every operator against a plain computation, on edge cases and the small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL

from footfall.llm import bpe, forest, neighbours, packing, queries, rules, simhash, suffixes
from footfall.llm.common import connected

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, rep long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
EDGES = [
    (1, None), (2, ""), (3, "one"), (4, "one two three"), (5, "a b c d e f g h"),
    (6, "Ünï cödé  text\twith\nlines\x0band more words here"), (7, LONG), (8, LONG), (8, LONG),
    (9, LONG[:5000] + " tail"), (10, "x" * 3000), (11, " \n\t "), (12, "ab" * 700), (None, "no id at all"),
    (None, None), (13, "one two three"), (14, "the cat sat on the mat the dog ran " * 6),
    (15, "a b   c  d   e\r\nf <|endoftext|> 's I'm don't 12345 !!! 🙂🙂"),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", "s", 1, "k", 2, 3) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


def both(*frames):
    return [f.select("doc_id", "text", "lang").collect() for f in frames]


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = top(u), top(v)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# 8: byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(edges, small, encoding):
    for df in (edges, small):
        got = Counter(map(tuple, bpe.token_digests(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()))
        want = Counter()
        for r in df.collect():
            ids = encoding.encode_ordinary(r.text or "")
            want[
                r.doc_id,
                len(ids),
                hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((r.text or "").encode()).hexdigest(),
            ] += 1
        assert got == want


def test_bpe_heap_and_matrix_agree(encoding, monkeypatch):
    coder = bpe.Bpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = [w.encode() for w in ("a" * 3000, "ab" * 1500, "hello", " thing", "=" * 2500, "abcabcab" * 20, "é" * 90)]
    plain = [encoding.encode_ordinary(w.decode()) for w in words]
    assert coder.encode_words(words) == plain
    monkeypatch.setattr(bpe, "LONG", 10_000)
    assert coder.encode_words(words) == plain
    assert [coder.decode(i) for i in plain] == words


# 9: packing


def check_packing(rows, docs, tokenizer):
    want = Counter()
    for r in docs:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(filled), -(-sum(r.length for r in rows) // 4096)


def test_packing(edges, small, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    for df, group in ((edges, 8192), (small, 16), (small, 8192)):
        used, least = check_packing(packing.packed_documents(df, path, group=group).collect(), df.collect(), tokenizer)
        assert used <= least * 1.03 + 1
    assert packing.packed_documents(nothing, path).count() == 0


def test_word_ids_on_odd_text():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(3)
    texts = ["Σίσυφος ΟΔΟΣ. été İstanbul'll don't, ... ,. x, . ,", "a\x1cb e\x85f\u2028g\u3000h. é. K", "it's 3.5, _. ,! <|endoftext|>"]
    for letters in ("aZéÉΣσİı'.,s t١9²中\u0301\x1c\xa0!-Å", "aB.,9 '_ x", "ab. , "):
        texts += ["".join(rng.choice(list(letters), rng.integers(1, 40))) for _ in range(500)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.WordIds(path).packed(texts) == want


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_constraint(rule):
    items = np.random.default_rng(3).integers(1, 60, (300, 3))
    bins = packing.best_fit(items, (100, 90, 80), (1, 1, 1), rule)
    for b in set(bins.tolist()):
        assert (items[bins == b].sum(axis=0) <= (100, 90, 80)).all()
    assert len(set(bins.tolist())) < 300
    with pytest.raises(ValueError):
        packing.best_fit([[5, 1, 1]], (4, 4, 4))


# 2: quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), base
    )


def test_rule_counts(spark, edges, small, nothing):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    for df in (edges, small):
        got = rules.judged(df, labels).collect()
        want = Counter((r.doc_id, *plain_counts(r.text or "")) for r in df.collect())
        assert Counter(tuple(r)[:7] for r in got) == want
        assert not any(r.base_failed and r.kept for r in got)
    assert rules.judged(nothing, labels.where("false")).count() == 0


def test_cutoffs_are_certified(spark):
    rows = [(i, f"{'bad!! ' if i % 5 == 0 else 'good '}" * 15 + " ".join(f"w{j}{i}" for j in range(60)), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(4000)], "doc_id long, quality int")
    got = rules.judged(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got)
    few = rules.judged(docs, labels.where("doc_id < 50")).collect()
    assert all(r.kept for r in few)


def test_texts_without_words_meet_every_certified_rule(spark):
    # Each language has words of 60 letters as its bad texts, so the rule on letters per word is certified in both.
    good, bad = (" ".join(f"{w}{j}" for j in range(30)) for w in ("w", "x" * 60))
    rows = [(i, good if i % 900 < 700 else bad, "en" if i < 900 else "fr") for i in range(1800)]
    odd = [(1800, None, "en"), (1801, "", "fr"), (1802, " \n\t", "en"), (1803, None, None), (1804, "one", "fr")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 900 < 700)) for i in range(1800)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert len(got) == 1805
    assert all(got[i].failed_rules == ([] if got[i].kept else ["chars_per_word"]) for i in range(1800))
    assert all(got[i].kept == (i % 900 < 700) for i in range(1800))
    assert all(got[i].base_failed and not got[i].kept and got[i].failed_rules == [] for i in range(1800, 1805))


def test_binomial_bound():
    assert abs(rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** 0.01)) < 1e-9
    p = rules.upper_bound(3, 50, 0.01)
    from math import comb

    assert abs(sum(comb(50, k) * p**k * (1 - p) ** (50 - k) for k in range(4)) - 0.01) < 1e-9


# 3: votes


def test_votes_on_held_out_rows(spark, edges, nothing):
    sf = SF_SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in neighbours.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    # The small table has 40 bad labels to learn from.
    assert sum(a == b for a, b in test) >= 0.9 * len(test)
    odd = neighbours.scored(edges, labels).collect()
    assert len(odd) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert {r.score for r in neighbours.scored(edges, labels.where("false")).collect()} == {0.5}
    assert neighbours.scored(nothing, labels).count() == 0


def test_votes_by_hand():
    known = np.array([[1.0, 0], [0, 1.0], [0.8, 0.6]])
    got = neighbours.votes(np.array([[1.0, 0]]), known, np.array([1.0, 0, 0]), 0.5, 2)
    assert abs(got[0] - 2 / (3 + 0.8**4)) < 1e-6


# 4: vectors


def test_forest_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.1 * rng.standard_normal(16)).tolist(), 0) for i in range(700)]
    rows += [(700 + i, rows[3][1], 0) for i in range(5)] + [(710, None, 1), (711, [0.0] * 16, 1), (712, [None] + [1.0] * 15, 1)]
    rows += [(713, [float("nan")] + [1.0] * 15, 1), (714, [float("inf")] + [1.0] * 15, 1), (715, [], 1), (716, [1.0, 2.0], 1), (717, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int").repartition(4)
    ok = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    near = defaultdict(set)
    for a, x in ok.items():
        for b, y in ok.items():
            if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                near[a].add(b)
    top = components([r[0] for r in rows], [(a, b) for a in near for b in near[a]])
    exact = forest.near_vectors(df).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in exact} == {(i, len(near[i]), top[i], top[i] == i) for i, _, _ in rows}
    # Small leaves: links may be missed but never counted twice or invented.
    split = forest.near_vectors(df, leaf=32, spill=0.1, wide=40).collect()
    assert all(r.n_links <= len(near[r.vec_id]) for r in split)
    assert sum(r.n_links for r in split) >= 0.9 * sum(map(len, near.values()))
    assert forest.near_vectors(df.where("false")).count() == 0


def test_forest_sets_are_joined_like_a_plain_search():
    rng = np.random.default_rng(4)
    label, plain = np.arange(300), list(range(300))
    for _ in range(6):
        i, j = rng.integers(0, 300, 40), rng.integers(0, 300, 40)
        label = forest.joined(label, i, j)
        for a, b in zip(i, j):
            low, high = sorted((plain[a], plain[b]))
            plain = [low if p == high else p for p in plain]
        assert label.tolist() == plain


def test_forest_rows_without_an_id_and_rows_that_share_one(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [0.0, 1.0])]
    rows += [(8, [-1.0, 0.0]), (8, [0.0, -1.0]), (9, [0.0, -1.01]), (7, [-1.01, 0.0]), (7, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.near_vectors(df).collect()
    want = [(None, 0, None, False)] * 2 + [(5, 1, 5, True)] * 2 + [(6, 0, 6, True), (7, 0, 7, True), (7, 1, 7, True)]
    want += [(8, 1, 7, False), (8, 1, 8, True), (9, 1, 8, False)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_forest_on_a_noisy_dense_group(spark):
    rng = np.random.default_rng(15)
    centre = rng.standard_normal(64)
    noise = rng.standard_normal((5_000, 64)) * np.sqrt(1 / 0.975 - 1)
    x = np.concatenate([centre + noise, rng.standard_normal((10_000, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = near.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r for r in forest.near_vectors(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert len(got) == len(x) and want[:5_000].min() > 1_024
    assert (found[:5_000] == want[:5_000]).all() and (found <= want).all()
    assert all(got[i].component_id == 0 and got[i].kept == (i == 0) for i in range(5_000))


# 5: repeated bytes


def plain_repeats(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        out.append(np.cumsum(gone)[: len(t)] > 0)
    return out


def check_repeats(df, length=400, gram=64):
    rows = df.collect()
    texts = [(r.text or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, plain_repeats(texts, length)):
        kept = bytes(b for b, g in zip(t, gone.tolist()) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(t) else 0
        want[r.doc_id, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, suffixes.deduplicated(df, length=length, gram=gram).collect())) == want


def test_repeats(edges, small, nothing):
    check_repeats(edges)
    check_repeats(small)
    assert suffixes.deduplicated(nothing).count() == 0


def test_repeats_with_overlaps(spark, monkeypatch):
    rng = np.random.default_rng(1)
    letters = lambda n: "".join(rng.choice(list("abcdef"), n))
    shared = [letters(n) for n in (60, 130, 75)]
    texts = [letters(rng.integers(0, 90)) + shared[rng.integers(3)][rng.integers(20) :] + letters(rng.integers(90)) for _ in range(120)]
    texts += ["a" * 200, "ab" * 90, "ab" * 100, shared[0] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    check_repeats(df, 40, 16)
    monkeypatch.setattr(suffixes, "PIECE", 64)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 4_000)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    monkeypatch.setattr(suffixes, "PAIRWISE", 3)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 3_000)
    kept, write = {}, suffixes.written

    def remembered(table, label):
        kept[label] = write(table, label)
        return kept[label]

    monkeypatch.setattr(suffixes, "written", remembered)
    check_repeats(df, 40, 8)
    # Many buckets, and one row per suffix: the join back cannot multiply anchors.
    assert kept["anchors-kept"].count() * 53 > 10 * suffixes.BUCKET_BYTES
    reach = kept["reach"].groupBy("gram", "whole").count()
    assert reach.count() > 50 and reach.where("count > 1").count() == 0


def check_passages(df, length, passage, gram):
    """Bytes of shorter passages are counted; what is removed stays that of the length alone."""
    rows = df.collect()
    texts = [(r.text or "").encode() for r in rows]
    alone = Counter(map(tuple, suffixes.deduplicated(df, length=length, gram=gram).collect()))
    found = suffixes.deduplicated(df, length=length, gram=gram, passage=passage).collect()
    assert Counter(tuple(r)[:5] for r in found) == alone
    want = Counter((r.doc_id, int(gone.sum())) for r, gone in zip(rows, plain_repeats(texts, passage)))
    assert Counter((r.doc_id, r.n_passage_bytes) for r in found) == want
    return found


def test_passages_shorter_than_the_length(spark, edges, monkeypatch):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    # A passage of 52 words and 311 bytes in two documents, one of 90 words in two others.
    short, long = words(52), words(90)
    texts = [f"{words(40)} {p} {words(30)}" for p in (short, short, long, long)] + [words(150) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed > 0, r.n_passage_bytes >= 311) for r in check_passages(df, 400, 240, 64)}
    assert got == {i: (i in (2, 3), i < 4) for i in range(8)}
    check_passages(edges, 400, 240, 64)
    # Pieces shorter than the windows, many buckets, large groups.
    letters = lambda n: "".join(rng.choice(list("abc"), n))
    shared = [letters(n) for n in (30, 60, 130)]
    texts = [letters(rng.integers(60)) + shared[rng.integers(3)][rng.integers(9) :] + letters(rng.integers(60)) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate([*texts, "a" * 200, "ab" * 90])), "doc_id long, text string").repartition(4)
    for name, value in (("PIECE", 32), ("RUN_BYTES", 3_000), ("BLOCK_BYTES", 400), ("PAIRWISE", 3), ("BUCKET_BYTES", 3_000)):
        monkeypatch.setattr(suffixes, name, value)
    check_passages(df, 40, 24, 16)


def test_the_query_reports_short_passages(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    short = words(52)
    rows = [(i, f"{words(40)} {short if i < 2 else words(52)} {words(30)}") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.n_passage_bytes} == {0, 1} and not any(r.n_removed for r in got)


def test_loser_tree_merges_without_losing_prefixes():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(1, 12)).tolist()) for _ in range(k)) for k in (0, 1, 7, 30, 5)]
    coded = [[(t, s, c) for t, s, c in suffixes.decoded(suffixes.front_coded([(t, 1) for t in run]))] for run in runs]
    got = list(suffixes.LoserTree(coded))
    assert [g[0] for g in got] == sorted(t for run in runs for t in run)
    before = b""
    for text, shared, _ in got:
        assert shared == suffixes.lcp(before, text)
        before = text


# 6: SimHash


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def test_simhash(edges, small, nothing):
    for df in (edges, small):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
        known = [r for r in rows if r[0] is not None]
        links = [(a, b) for a, x in known for b, y in known if a != b and (x ^ y).bit_count() <= 4]
        top = components([a for a, _ in known], links)
        got = simhash.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((a, x, top.get(a)) for a, x in rows)
    assert simhash.near_duplicates(nothing).count() == 0


def test_dense_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(8)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 60)]
    for p in list(prints[:20]):
        for _ in range(25):
            prints.append(p ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 63, rng.integers(1, 7)))))
    rows = [(i, f) for i, f in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda d, n: d)
    links = [(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) % 2**64).bit_count() <= 4]
    top = components([a for a, _ in rows], links)
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == set(top.items())


def test_connected(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(links, "u long, v long")
    nodes = {x for p in links if p[0] != p[1] for x in p}
    top = components(nodes, [p for p in links if p[0] != p[1]])
    assert {(r.node, r.component_id) for r in connected(df, "test").collect()} == set(top.items())


def test_every_query_runs_on_the_small_tables(spark):
    assert len({name.split("_")[0] for name in queries.QUERIES}) == len(queries.QUERIES)

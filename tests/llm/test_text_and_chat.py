"""Personal data, role repair, licence digests and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL, START  # noqa: F401

import corpus_pipeline
from footfall.llm import chat, licences, neighbours, pii, queries

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            n = len(re.sub("[^0-9]", "", m[0]))
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m=m, n=n: 14 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0])),
                "phone": lambda n=n: 10 <= n <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_patterns_on_random_text():
    rng = np.random.default_rng(0)
    letters = list("ab@@..--++  ()0123456789%é\n")
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 45)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 50_000 + "@" + "1." * 20_000) == plain_spans("a" * 3 + "@" + "1." * 3)[:0] + [
        ("email", 0, 50_001 + 2 * 20_000 - 1)
    ] + [("ip", 50_001 + 8 * k, 50_008 + 8 * k) for k in range(5000)]


def test_spans_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet")
    extra = [(-1, None), (-2, ""), (-3, "call (988) 555-2485 now"), (-4, "+1 (269) 555-3296 4524132264652876"), (None, "a@b.cd")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra * 2, "doc_id long, text string"))
    rows = pii.found_spans(docs).collect()
    texts = Counter()
    for r in docs.collect():
        base = plain_spans(r.text or "")
        texts[r.doc_id, *[sum(s[0] == k for s in base) for k in pii.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in rows) == texts
    by = {r.doc_id: r.spans for r in rows}
    assert by[-1] == by[-2] == "" and by[-3] == "phone:5:19" and by[-4] == "phone:0:17,card:18:34" and by[None] == "email:0:6"
    # Base spans are always among all spans.
    for r in docs.collect():
        assert {f"{k}:{a}:{z}" for k, a, z in plain_spans(r.text or "")} <= set(by[r.doc_id].split(","))
    assert pii.found_spans(docs.where("false")).count() == 0


def test_field_finds_the_best_segmentation():
    rng = np.random.default_rng(6)
    field = pii.Field(rng.standard_normal((5, len(pii.NAMES))))
    text = "1 22 333 (4) +5"
    words = pii.zones(text)[0]
    found, rows = pii.segments(text, words)
    score = field.scores(found, rows)
    score[:, 1:] -= pii.MARGIN
    place = {f[:2]: k for k, f in enumerate(found)}
    best = -np.inf
    for cuts in itertools.product((0, 1), repeat=len(words) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(words)]
        best = max(best, sum(score[place[a, z]].max() for a, z in zip(edges, edges[1:])))
    got = field.best(text, words)
    chosen, at = 0.0, 0
    for kind, a, z in got:
        k = next(k for k, f in enumerate(found) if f[2:] == (a, z) and np.isfinite(score[k]).any())
        chosen += score[k, pii.KINDS.index(kind) + 1]
        at += found[k][1] - found[k][0]
    assert chosen <= best + 1e-9


def test_redaction():
    text = "a b@c.de f 1.2.3.4"
    assert pii.redacted_text(text, pii.base_spans(text)) == "a [EMAIL] f [IP]"
    assert pii.redacted_text("xx", []) == "xx"


# 7: roles


def cheapest(roles):
    """Least cost over all repairs, by breadth over edits."""
    best = {(0, chat.START): 0}
    for i in range(len(roles) + 1):
        for _ in range(3):
            for s in range(4):
                for n in chat.NEXT[s]:
                    c = best.get((i, s), chat.NEVER) + chat.INSERT
                    best[i, n] = min(best.get((i, n), chat.NEVER), c)
        if i == len(roles):
            break
        for s in range(4):
            c = best.get((i, s), chat.NEVER)
            for n in chat.NEXT[s]:
                cost = 0 if n == roles[i] else chat.GUESS if roles[i] == 0 else chat.RELABEL
                best[i + 1, n] = min(best.get((i + 1, n), chat.NEVER), c + cost)
            if s:
                cost = chat.MERGE_SAME if roles[i] in (0, s) else chat.MERGE_OTHER
                best[i + 1, s] = min(best.get((i + 1, s), chat.NEVER), c + cost)
    return best[len(roles), chat.ASSISTANT]


LEGAL = re.compile(r"(<\|system\|>\n[^<]*<\|end\|>\n)?(<\|user\|>\n[^<]*<\|end\|>\n<\|assistant\|>\n[^<]*<\|end\|>\n)+")


@pytest.mark.parametrize("block", [3, 256])
def test_repairs_are_legal_and_cheapest(spark, block):
    rng = np.random.default_rng(9)
    rows = []
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            role = ["system", "User ", "assistant", "tool", None][rng.integers(5)]
            rows.append((conv, turn, role, f"t{conv}.{turn}", "x", 1))
    rows += [(100, t, "user" if t % 3 else "assistant", f"long {t}", "x", 1) for t in range(900)]
    rows += [(None, 0, "user", None, "x", 1), (101, None, "assistant", "a", "x", 1), (101, 0, "user", "", "x", 1)]
    rows += [(102, 1, "user", "same", "x", 1)] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, run int").repartition(4)
    got = chat.repaired(df, block).collect()
    assert len(got) == len(rows)
    for conv, group in itertools.groupby(sorted(got, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.position)), lambda r: r.conv_id):
        group = list(group)
        assert [r.position for r in group] == list(range(len(group)))
        assert LEGAL.fullmatch("".join(r.fragment for r in group)), conv
        assert sum(r.cost for r in group) == cheapest([chat.role_of(r.role) for r in group])
    assert chat.repaired(df.where("false")).count() == 0


def test_kept_chats_cost_nothing(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")]
    got = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.action, r.cost, r.fragment) for r in got.orderBy("position").collect()] == [
        ("keep", 0, "<|system|>\ns"), ("keep", 0, "<|end|>\n<|user|>\nq"), ("keep", 0, "<|end|>\n<|assistant|>\na<|end|>\n")
    ]


# 10: licences


def test_licences(spark):
    mit = dict(licences.KNOWN)["notice-MIT"]
    long = next(t for n, t in licences.KNOWN if n == "BSD-3-Clause")
    rows = [
        (1, long), (2, "Copyright (c) 2020 Someone\n\n" + long.upper().replace("LICENSE", "LICENCE").replace(". ", ".\n\t ")),
        (3, mit.replace("License", "Licence!!")), (4, long + " more"), (5, None), (6, ""), (7, "текст"), (7, "текст"),
        (8, "“" + long.replace('"', "”")), (None, mit),
    ]
    got = licences.matched(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.licence) for r in got) == Counter(
        [(1, "BSD-3-Clause"), (2, "BSD-3-Clause"), (3, "notice-MIT"), (4, None), (5, None), (6, None), (7, None), (7, None), (8, "BSD-3-Clause"), (None, "notice-MIT")]
    )


def test_wrapped_licences_and_given_texts(spark):
    import textwrap

    rows, want = [], {}
    for k, (name, text) in enumerate(licences.KNOWN):
        for j, width in enumerate((30, 47, 72, 78)):
            head = ["", "Copyright (c) 2020 A. Author\n\n", "COPYRIGHT 1999-2001 THE AUTHORS\nAll rights reserved.\n", "Copyright Jane Doe\n"][j]
            rows.append((100 * k + j, head + "\n".join(textwrap.wrap(text, width))))
            want[100 * k + j] = name
    isc = next(t for n, t in licences.KNOWN if n == "ISC")
    # The words that the usual file has at the start of a line.
    rows.append((-1, isc.replace("above copyright notice", "above\ncopyright notice")))
    rows.append((-2, "My own\nterms"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([("own", "MY OWN TERMS!", 1), ("other", None, 2)], "licence string, text string, digest int")
    got = {r.doc_id: r.licence for r in licences.matched(df, known).collect()}
    assert got == want | {-1: "ISC", -2: "own"}


def test_licences_match_sql(spark):
    from oracle_check import compare, connect

    for name, sql in queries.ORACLES.items():
        assert compare(spark, connect(SF_SMALL), SF_SMALL, queries.QUERIES[name], sql) == ""


# The pipeline


def test_pipeline_against_plain_computations(spark):
    from test_contracts import check_packing, components, plain_fingerprint, plain_repeats
    from tokenizers import Tokenizer

    sf = SF_SMALL
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    def rows(df):
        assert df.dtypes == docs.dtypes
        return {r.doc_id: r for r in df.collect()}

    first = stages["quality classifier"](spark, docs, sf).cache()
    good = {r.doc_id for r in neighbours.scored(docs, labels).collect() if r.predicted == 1}
    assert rows(first) == {k: r for k, r in rows(docs).items() if k in good}

    second = stages["SimHash near-dedup"](spark, first, sf).cache()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in first.collect()]
    links = [(a, b) for a, x in prints for b, y in prints if a != b and (x ^ y).bit_count() <= 4]
    top = components([a for a, _ in prints], links)
    assert rows(second) == {k: r for k, r in rows(first).items() if top[k] == k}

    third = stages["suffix-array dedup"](spark, second, sf).cache()
    before = second.collect()
    texts = [r.text.encode() for r in before]
    want = {
        r.doc_id: bytes(b for b, g in zip(t, gone.tolist()) if not g).decode(errors="ignore")
        for r, t, gone in zip(before, texts, plain_repeats(texts, corpus_pipeline.PASSAGE_BYTES))
    }
    got = rows(third)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (b.lang, b.source) for b in before for r in [got[b.doc_id]])

    fourth = stages["PII"](spark, third, sf).cache()
    field = pii.trained(third)
    redacted = {r.doc_id: pii.redacted_text(r.text, pii.all_spans(r.text, field)[1]) for r in third.collect()}
    assert {k: r.text for k, r in rows(fourth).items()} == redacted
    assert not any(plain_spans(t) for t in redacted.values())

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    fifth = stages["best-fit packing"](spark, fourth, sf).collect()
    used, least = check_packing(fifth, fourth.collect(), tokenizer)
    assert used <= least * 1.03 + 1
    pieces = Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert pieces == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in fifth)


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (2, "", "en", "s", 0), (3, "x " * 30_000, "en", "s", 60_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF_SMALL)
            out.count()
            if name != "best-fit packing":
                assert out.dtypes == odd.dtypes


def test_near_unique_keeps_one_row_of_each_group(spark):
    rng = np.random.default_rng(12)
    a, b, c, d, e = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 150)) for _ in range(5))
    rows = [(1, a)] * 3 + [(None, b)] * 3 + [(4, c), (None, c), (None, c)] + [(6, d), (7, d), (7, d)] + [(8, e[:500]), (8, e)]
    rows += [(9, None), (9, None), (None, ""), (None, None)]
    df = spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(5)
    once = corpus_pipeline.near_unique(spark, df, SF_SMALL).cache()
    want = {(1, a), (None, b), (4, c), (6, d), (8, e), (9, None)}
    assert once.dtypes == df.dtypes and Counter((r.doc_id, r.text) for r in once.collect()) == Counter(want)
    # Suffix removal sees every text once and cuts nothing.
    left = corpus_pipeline.unrepeated(spark, once, SF_SMALL).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter((i, t or "") for i, t in want)

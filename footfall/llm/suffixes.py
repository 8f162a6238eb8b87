"""Removal of long repeated byte strings by a distributed sort of suffixes.

Suffixes start at anchors: the position of the smallest hash of ``GRAM`` bytes in
each window of ``length`` bytes. Equal windows have the same anchor, so a repeat
is always seen from anchors at equal places. An anchor stands for the windows it
was chosen in; the bytes those span, read right from the anchor and then left
from it, make its suffix.

1. Anchors whose gram occurs once cannot lie in a repeat and are left out.
2. Each task sorts its suffixes to runs, merges equal ones and front-codes the
   rest: shared prefix length and remaining bytes.
3. Runs are exchanged by gram. A loser tree merges the runs of a bucket. Every
   player knows its common prefix with the last winner; a match compares two
   texts only where both prefixes are equally long, and only beyond them.
4. Neighbours in the merged order that share a gram are resolved exactly: a
   suffix that occurs twice is a repeat in all its windows; others get the
   largest extension left and right over windows shared with another suffix.
5. Extensions return to their documents, where their union is cut out.

Several lengths can be sought at once. Texts are then hashed and shuffled once for
all of them; suffixes of different lengths are kept apart.

Defined results: a null text is an empty one; texts shorter than ``length`` keep
all bytes; rows are documents, so repeated rows repeat each other; an empty table
gives an empty table. Very long texts are scanned in pieces that overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import map_columns, written

LENGTH = 400
GRAM = 64
PIECE = 1 << 20
RUN_BYTES = 24_000_000
BLOCK_BYTES = 400_000
BUCKET_BYTES = 12_000_000
PAIRWISE = 24
NO_ID = -(2**63)

_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.uint64(0xFFFFFF)


def gram_hashes(raw: bytes, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position, with the position in its low bits."""
    h = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size, power = 1, _MULTIPLY
    # Double the grams; the last step may overlap.
    while size < gram:
        h = h[:-size] * power + h[size:]
        with np.errstate(over="ignore"):
            power, size = power * power, size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)


def window_anchors(least: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """First window, last window and anchor of every run of windows with one anchor.

    ``least`` are the ``gram_hashes`` of documents one after the other, ``ends`` where
    each one ends.
    """
    n = int(ends[-1]) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    wide, step = length - gram + 1, 1
    while step * 2 <= wide:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    if step < wide:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    anchor = (least & _PLACE).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    a = anchor[at]
    new = np.flatnonzero((np.diff(a) != 0) | (np.diff(at) != 1)) + 1
    first, last = np.r_[0, new], np.r_[new, len(at)] - 1
    return at[first], at[last], a[first]


def anchors(docs: DataFrame, lengths=(LENGTH,), gram: int = GRAM) -> DataFrame:
    """``id, code, place, gram`` and per length ``span`` and ``whole``: anchors with
    hashes of gram and suffix.

    ``place`` is the position, shifted by 24 bits for the number of a length and
    ``span``: the distances from the anchor to the start of its last and first
    window, ten bits each. They are null for a length that has no window there.
    """
    least, most = min(lengths), max(lengths)

    def step(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        signed = lambda x: x - 2**64 if x >= 2**63 else x

        def found(parts):
            raw = b"".join(p[3] for p in parts)
            ends = np.cumsum([len(p[3]) for p in parts])
            starts = ends - np.array([len(p[3]) for p in parts])
            base = np.array([p[2] for p in parts]) - starts
            ids, codes = [p[0] for p in parts], [p[1] for p in parts]
            hashes = gram_hashes(raw, gram)
            runs = []
            for length in lengths:
                first, last, at = window_anchors(hashes, ends, length, gram)
                stop = starts[np.searchsorted(ends, first, side="right")] + PIECE
                # Windows from ``PIECE`` on are those of the next piece.
                own = first < stop
                runs.append((first[own], np.minimum(last, stop - 1)[own], at[own]))
            places = np.unique(np.concatenate([at for _, _, at in runs]))
            owner = np.searchsorted(ends, places, side="right")
            out = {
                "id": [ids[o] for o in owner.tolist()],
                "code": [codes[o] for o in owner.tolist()],
                "place": (places + base[owner]) << 24,
                "gram": [signed(digest(raw[a : a + gram])) for a in places.tolist()],
            }
            for kind, (length, (first, last, at)) in enumerate(zip(lengths, runs)):
                near, far = at - last, at - first
                spans, wholes = [None] * len(places), [None] * len(places)
                for i, s, e, n, f in zip(*(x.tolist() for x in (np.searchsorted(places, at), first, last, near, far))):
                    spans[i], wholes[i] = (n << 10) | f, signed(digest(raw[s : e + length], (kind << 10) | f))
                out[f"span{kind}"], out[f"whole{kind}"] = spans, wholes
            return out

        for b in batches:
            held, parts = 0, []
            for key, code, text in zip(b["id"], b["code"], b["text"]):
                raw = text.encode()
                for start in range(0, max(1, len(raw) - least + 1), PIECE):
                    part = raw[start : start + PIECE + most - 1]
                    if len(part) >= least:
                        parts.append((key, code, start, part))
                        held += len(part)
                    if held >= PIECE:
                        yield found(parts)
                        held, parts = 0, []
            if parts:
                yield found(parts)

    schema = "id long, code long, place long, gram long"
    schema += "".join(f", span{k} int, whole{k} long" for k in range(len(lengths)))
    return map_columns(docs.where(F.octet_length("text") >= least), step, schema)


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return at + (m - 1 - (d.bit_length() - 1) // 8 if d else m)
        at += 64
    return n


def front_coded(rows: list[tuple[bytes, int]]) -> bytes:
    """Sorted texts and their counts as shared prefix lengths and remainders."""
    import zstandard

    shared, before = [], b""
    for text, _ in rows:
        shared.append(lcp(before, text))
        before = text
    rest = [t[s:] for (t, _), s in zip(rows, shared)]
    head = np.array([len(rows)], "<u4").tobytes()
    columns = (
        np.array(shared, "<u4").tobytes()
        + np.array([len(r) for r in rest], "<u4").tobytes()
        + np.array([c for _, c in rows], "<u4").tobytes()
    )
    return zstandard.compress(head + columns + b"".join(rest), 3)


def decoded(block: bytes):
    """``text, shared prefix with the text before, count`` of a block, in order."""
    import zstandard

    raw = zstandard.decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    shared, size, count = np.frombuffer(raw, "<u4", 3 * n, 4).reshape(3, n).tolist()
    at, before = 4 + 12 * n, b""
    for s, z, c in zip(shared, size, count):
        before = before[:s] + raw[at : at + z]
        at += z
        yield before, s, c


class LoserTree:
    """Merge of sorted runs of ``text, shared prefix, count`` without comparing
    prefixes that are known."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.width = 1
        while self.width < max(1, len(self.runs)):
            self.width *= 2
        self.text: list[bytes | None] = [None] * self.width
        self.count = [0] * self.width
        self.loser = [-1] * self.width
        self.known = [-1] * self.width
        for i, r in enumerate(self.runs):
            if (row := next(r, None)) is not None:
                self.text[i], self.count[i] = row[0], row[2]
        best = [(i, 0 if self.text[i] is not None else -1) for i in range(self.width)]
        players = [None] * self.width + best
        for node in range(self.width - 1, 0, -1):
            players[node], (self.loser[node], self.known[node]) = self._match(players[2 * node], players[2 * node + 1])
        self.winner, self.shared = players[1]

    def _match(self, a, b):
        """Winner and loser of two players ``run, prefix shared with the last winner``."""
        (i, p), (j, q) = a, b
        if p != q or p < 0:
            return (a, b) if p >= q else (b, a)
        s, t = self.text[i], self.text[j]
        h = lcp(s, t, p)
        return (a, (j, h)) if s[h:] <= t[h:] else (b, (i, h))

    def __iter__(self):
        while self.shared >= 0:
            i = self.winner
            yield self.text[i], self.shared, self.count[i]
            row = next(self.runs[i], None)
            if row is None:
                self.text[i], player = None, (i, -1)
            else:
                self.text[i], p, self.count[i] = row
                player = (i, p)
            node = (i + self.width) // 2
            while node:
                q = self.known[node]
                if player[1] > q:
                    pass
                elif player[1] < q:
                    player, (self.loser[node], self.known[node]) = (self.loser[node], q), player
                elif q >= 0:
                    player, (self.loser[node], self.known[node]) = self._match(player, (self.loser[node], q))
                node //= 2
            self.winner, self.shared = player


def _runs(blocks: dict[int, list[bytes]]):
    def run(parts):
        for k, part in enumerate(parts):
            for n, (text, shared, count) in enumerate(decoded(part)):
                if n == 0 and k:
                    shared = lcp(before, text)  # noqa: F821  (set by the block before)
                yield text, shared, count
                before = text

    return [run(parts) for parts in blocks.values()]


def resolve(group: list[tuple[bytes, int, int]], length: int):
    """Reach left and right of the anchor for every suffix of one gram, or None.

    ``group`` is sorted: text, prefix shared with the text before, count. A text
    is the bytes right of the anchor, those left of it reversed, and the number
    of the former in two bytes.
    """
    right = [int.from_bytes(t[-2:]) for t, _, _ in group]
    left = [len(t) - 2 - r for (t, _, _), r in zip(group, right)]
    out = [(l, r) if c > 1 else None for (_, _, c), l, r in zip(group, left, right)]
    if len(group) == 1 or all(out):
        return out
    far = [[-1, -1] for _ in group]
    if len(group) <= PAIRWISE:
        for i, (s, _, c) in enumerate(group):
            common = len(s)
            for j in range(i + 1, len(group)):
                t, shared, d = group[j]
                common = min(common, shared)
                r = min(common, right[i], right[j])
                if (c > 1 and d > 1) or r + min(left[i], left[j]) < length:
                    continue
                le = lcp(s[right[i] : -2], t[right[j] : -2])
                if le + r >= length:
                    for k in (i, j):
                        far[k] = [max(far[k][0], le), max(far[k][1], r)]
    else:
        # Per distance from the anchor, the windows themselves: linear in the group.
        around = [t[r:-2][::-1] + t[:r] for (t, _, _), r in zip(group, right)]
        for o in range(min(length - r for r in right), max(left) + 1):
            seen: dict[bytes, int] = {}
            for i, (le, r) in enumerate(zip(left, right)):
                if length - r <= o <= le:
                    window = around[i][le - o : le - o + length]
                    j = seen.setdefault(window, i)
                    if j != i:
                        for k in (i, j):
                            far[k] = [max(far[k][0], o), max(far[k][1], length - o)]
    return [o or (tuple(f) if f[0] >= 0 else None) for o, f in zip(out, far)]


def repeats(found: DataFrame, docs: DataFrame, lengths, gram: int) -> DataFrame:
    """``id, code, kind, start, stop``: bytes of each document covered by repeats of
    ``lengths[kind]`` bytes."""
    # Grams that occur twice. Written, so that both sides of the join are shuffled
    # for it and Spark can split a gram that many anchors share.
    twice = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    # One row per anchor and length from here on.
    each = [
        F.struct(
            F.col("place").bitwiseOR(F.lit(k << 20)).bitwiseOR(F.col(f"span{k}").cast("long")).alias("place"),
            F.col(f"whole{k}").alias("whole"),
        )
        for k in range(len(lengths))
    ]
    rows = found.join(twice, "gram").select("id", "code", "gram", F.explode(F.array(*each)).alias("a"))
    kept = written(rows.select("id", "code", "gram", "a.*").where("place IS NOT NULL"), "anchors-kept")
    texts = _packed_texts(docs.where(F.octet_length("text") >= min(lengths)))
    wanted = kept.groupBy("id", "code").agg(F.collect_set("place").alias("places"))
    rows = texts.join(wanted.hint("shuffle_hash"), ["id", "code"]).select("packed", "places")
    buckets = max(1, -(-kept.count() * (max(lengths) + max(lengths) // 3) // BUCKET_BYTES))

    def make_runs(batches):
        import xxhash
        import zstandard

        digest, number = xxhash.xxh64_intdigest, [0]
        texts: dict[bytes, int] = {}

        def flush():
            number[0] += 1
            order = sorted((digest(t[1 : gram + 1]) % buckets, t, c) for t, c in texts.items())
            at = 0
            while at < len(order):
                end, size = at, 0
                while end < len(order) and order[end][0] == order[at][0] and size < BLOCK_BYTES:
                    size += len(order[end][1])
                    end += 1
                yield order[at][0], number[0], at, front_coded([r[1:] for r in order[at:end]])
                at = end

        def emit():
            out = list(zip(*flush()))
            texts.clear()
            return dict(zip(("bucket", "run", "place", "block"), out))

        # Runs of different tasks must not share a name.
        number[0] = int.from_bytes(hashlib.sha256(str(_task()).encode()).digest()[:5]) << 20
        held = 0
        for b in batches:
            for packed, places in zip(b["packed"], b["places"]):
                raw = zstandard.decompress(packed)
                for p in places:
                    at, kind, near, far = p >> 24, (p >> 20) & 15, (p >> 10) & 1023, p & 1023
                    right = raw[at : at + lengths[kind] - near]
                    # The number of the length goes first, so lengths are sorted apart.
                    t = bytes((kind,)) + right + raw[at - far : at][::-1] + len(right).to_bytes(2)
                    n = texts.get(t, 0)
                    texts[t] = n + 1
                    held += 0 if n else len(t) + 100
                    if held > RUN_BYTES:
                        yield emit()
                        held = 0
        if texts:
            yield emit()

    runs = map_columns(rows, make_runs, "bucket long, run long, place long, block binary")

    def merge(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        signed = lambda x: x - 2**64 if x >= 2**63 else x

        def merged(blocks):
            out = {k: [] for k in ("gram", "whole", "left", "right")}
            group: list[tuple[bytes, int, int]] = []
            kind = 0

            def close():
                for (t, _, _), reach in zip(group, resolve(group, lengths[kind])):
                    if reach:
                        r = int.from_bytes(t[-2:])
                        far = len(t) - 2 - r
                        out["gram"].append(signed(digest(t[:gram])))
                        out["whole"].append(signed(digest(t[r:-2][::-1] + t[:r], (kind << 10) | far)))
                        out["left"].append(reach[0])
                        out["right"].append(reach[1])

            for named, shared, count in LoserTree(_runs(blocks)):
                text, shared = named[1:], shared - 1
                if group and named[0] == kind and text == group[-1][0]:
                    group[-1] = (text, group[-1][1], group[-1][2] + count)
                    continue
                if group and shared < gram:
                    close()
                    group = []
                kind = named[0]
                group.append((text, shared, count))
            if group:
                close()
            return out

        bucket, blocks = None, {}
        for b in batches:
            for k, run, block in zip(b["bucket"], b["run"], b["block"]):
                if k != bucket:
                    if blocks:
                        yield merged(blocks)
                    bucket, blocks = k, {}
                blocks.setdefault(run, []).append(block)
        if blocks:
            yield merged(blocks)

    exchanged = runs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "run", "place")
    reach = written(map_columns(exchanged, merge, "gram long, whole long, left long, right long"), "reach")
    at = F.shiftright("place", 24)
    # ``reach`` has one row per suffix, so there are as many spans as anchors; those of
    # anchors in no repeat are empty.
    spans = kept.join(reach, ["gram", "whole"], "left").select(
        "id",
        "code",
        F.shiftright("place", 20).bitwiseAND(F.lit(15)).alias("kind"),
        (at - F.coalesce("left", F.lit(0))).alias("start"),
        (at + F.coalesce("right", F.lit(0))).alias("stop"),
    )
    return spans.where("stop > start")


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _packed_texts(docs: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""

    def step(batches):
        import zstandard

        for b in batches:
            yield {"id": b["id"], "code": b["code"], "packed": [zstandard.compress(t.encode(), 3) for t in b["text"]]}

    return map_columns(docs.select("id", "code", "text"), step, "id long, code long, packed binary")


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def repeated_spans(docs: DataFrame, lengths=(LENGTH,), gram: int = GRAM) -> DataFrame:
    """``id, code, spans``: per id and text hash, the bytes in strings of ``lengths[kind]``
    bytes that also start elsewhere. A span packs its start, its kind in four bits and
    its size in eleven."""
    if min(lengths) < gram or max(lengths) > 1023:
        raise ValueError("the length must lie between the gram and 1023")
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("code", F.xxhash64("text"))
    found = written(anchors(keyed, lengths, gram), "anchors")
    spans = repeats(found, keyed, lengths, gram)
    packed = F.shiftleft("start", 15).bitwiseOR(F.shiftleft("kind", 11)).bitwiseOR(F.col("stop") - F.col("start"))
    return spans.groupBy("id", "code").agg(F.collect_set(packed).alias("spans"))


def deduplicated(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    carry=(),
    as_text: bool = False,
    passage: int | None = None,
) -> DataFrame:
    """Every document with what is kept of its bytes.

    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, the carried columns and,
    with ``as_text``, the kept bytes as ``text`` without broken characters. With
    ``passage``, ``n_passage_bytes`` counts the bytes in strings of that many bytes
    that also start elsewhere; they are reported, and removed only as ``length`` says.
    """
    spans = repeated_spans(docs, (length, passage) if passage else (length,), gram)
    named = [f"c{i}" for i in range(len(carry))]
    keyed = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.col(c).alias(n) for c, n in zip(carry, named)],
    ).withColumn("code", F.xxhash64("text"))
    kinds = dict(keyed.dtypes)

    def squeeze(batches):
        import zstandard

        for b in batches:
            b["packed"] = [zstandard.compress(t.encode(), 3) for t in b["text"]]
            yield b

    more = "".join(f", {n} {kinds[n]}" for n in named)
    packed = map_columns(keyed, squeeze, "doc_id long, id long, code long, packed binary" + more)
    rows = packed.join(spans.hint("shuffle_hash"), ["id", "code"], "left").drop("id", "code")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", n_passage_bytes long" * bool(passage)

    def cut(batches):
        import zstandard

        for b in batches:
            out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "text")}
            for doc, packed, spans in zip(b["doc_id"], b["packed"], b["spans"]):
                raw = zstandard.decompress(packed)
                gone, passages = (
                    merged_spans((s >> 15, (s >> 15) + (s & 2047)) for s in spans or () if (s >> 11) & 15 == kind)
                    for kind in (0, 1)
                )
                if gone:
                    edges = [0, *[x for s in gone for x in s], len(raw)]
                    left = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                else:
                    left = raw
                out["doc_id"].append(doc)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(len(raw) - len(left))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["n_passage_bytes"].append(sum(z - a for a, z in passages))
                if as_text:
                    out["text"].append(left.decode(errors="ignore"))
            yield out | {n: b[n] for n in named}

    result = map_columns(rows, cut, schema + ", text string" * as_text + more)
    for c, n in zip(carry, named):
        result = result.withColumnRenamed(n, c)
    return result

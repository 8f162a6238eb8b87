"""Byte-level BPE in length-bucketed padded matrices.

Pre-tokens of similar length share a padded numpy matrix of token ids. In every
round each row merges its leftmost pair of minimum rank, found by hashed lookup
of the id pairs; the row is compacted and only the two pairs beside the merge are
looked up again. Rows without a mergeable pair leave the matrix.

Defined results: a null or empty text has no ids; every text is encoded whole,
strings of special tokens are ordinary text; repeated rows give repeated results;
an empty table gives an empty table. Pre-tokens over ``LONG`` bytes take the same
merges from a heap, so that a run of one character stays near linear.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame

from footfall.llm.common import map_columns

LONG = 2_048
CELLS = 1_000_000
CACHED = 400_000
NONE = np.iinfo(np.int32).max

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """Open-addressed hash table from a pair of ids to the rank of their union."""

    def __init__(self, left, right, rank):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        rank = np.asarray(rank, np.int32)
        slot, self.probes = self._slots(keys), 1
        while len(keys):
            free = self.keys[slot] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            take = free & first
            self.keys[slot[take]], self.ranks[slot[take]] = keys[take], rank[take]
            keys, rank = keys[~take], rank[~take]
            slot = (slot[~take] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slots(self, keys):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """Ranks of id pairs; ``NONE`` where they do not merge or an id is padding."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), -2, keys)
        slot = self._slots(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((got != keys) & (got != -1) & (keys != -2))
        at = slot[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & (len(self.keys) - 1)
            got = self.keys[at]
            hit = got == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (got != -1)
            todo, at = todo[on], at[on]
        return out


class Bpe:
    """Encoder and decoder for a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.single = np.full(256, -1, np.int32)
        for b in range(256):
            self.single[b] = ranks.get(bytes([b]), -1)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(left, right, rank)
        self.pair_rank = None
        self._lists = (left, right, rank)

    @classmethod
    def from_file(cls, path: str) -> Bpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every pre-token, each encoded on its own."""
        out: list[list[int]] = [[] for _ in words]
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._from_heap(w)
            elif w:
                buckets.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, members in sorted(buckets.items()):
            step = max(1, CELLS >> bits)
            for k in range(0, len(members), step):
                self._matrix(words, members[k : k + step], out)
        return out

    def _matrix(self, words, members, out) -> None:
        size = np.array([len(words[i]) for i in members])
        wide = int(size.max())
        ids = np.full((len(members), wide), -1, np.int32)
        inside = np.arange(wide) < size[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(words[i] for i in members), np.uint8)]
        rows = np.array(members)

        def done(which):
            for r, line in zip(rows[which].tolist(), ids[which].tolist()):
                out[r] = line[: line.index(-1)] if line[-1] < 0 else line

        if wide == 1:
            done(np.arange(len(rows)))
            return
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), wide - 1)
        while len(rows):
            at = rank.argmin(axis=1)
            every = np.arange(len(rows))
            best = rank[every, at]
            on = best < NONE
            if not on.all():
                done(np.flatnonzero(~on))
                ids, rank, rows, at, best = ids[on], rank[on], rows[on], at[on], best[on]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            ids[every, at] = best
            # Compaction: everything right of the merge moves one place left.
            keep = np.arange(ids.shape[1] - 1) <= at[:, None]
            ids = np.where(keep, ids[:, :-1], ids[:, 1:])
            if ids.shape[1] == 1:
                done(every)
                return
            rank = np.where(keep[:, : rank.shape[1] - 1], rank[:, :-1], rank[:, 1:])
            last = ids.shape[1] - 2
            for place in (at - 1, at):
                ok = np.flatnonzero((place >= 0) & (place <= last))
                p = place[ok]
                rank[ok, p] = self.pairs.find(ids[ok, p], ids[ok, p + 1])

    def _from_heap(self, word: bytes) -> list[int]:
        """The same merges for one very long pre-token."""
        if self.pair_rank is None:
            self.pair_rank = dict(zip(zip(self._lists[0], self._lists[1]), self._lists[2]))
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pair_rank.get
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = r, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (q := get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (q, a))
        return [i for i in ids if i is not None]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextCoder:
    """Encodes whole texts; what a pre-token encodes to is remembered."""

    def __init__(self, bpe: Bpe, pattern: str):
        import regex

        self.bpe, self.split = bpe, regex.compile(pattern).findall
        self.decimal = {i: b"%d" % i for i in bpe.tokens}
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        text = self.decimal.__getitem__
        for w, ids in zip(words, self.bpe.encode_words([w.encode() for w in words])):
            self.ids[w] = b" ".join(map(text, ids))
            self.decoded[w] = self.bpe.decode(ids)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Per text: its decimal ids joined by blanks, and the bytes decoded from them."""
        cut = [self.split(t) if t else [] for t in texts]
        words = set().union(*cut)
        if len(self.ids) > CACHED:
            self.ids.clear()
            self.decoded.clear()
        self.learn(list(words - self.ids.keys()))
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        return [(b" ".join(map(ids, ws)), b"".join(map(decoded, ws))) for ws in cut]


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded bytes per text.

    One row per input row, in one pass without a shuffle. ``ranks_path`` names a
    rank file that every executor can read.
    """

    def step(batches):
        coder = TextCoder(Bpe.from_file(ranks_path), pattern)
        sha = hashlib.sha256
        for b in batches:
            coded = coder.encode(b["text"])
            yield {
                "doc_id": b["doc_id"],
                "n_tokens": [i.count(b" ") + 1 if i else 0 for i, _ in coded],
                "ids_sha256": [sha(i).hexdigest() for i, _ in coded],
                "decoded_sha256": [sha(d).hexdigest() for _, d in coded],
            }

    return map_columns(docs.select("doc_id", "text"), step, ENCODED)

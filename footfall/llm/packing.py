"""Vector best-fit packing of token sequences.

A piece costs a vector: tokens, one document, and attention (tokens squared). A
sequence has a capacity in each. Pieces are taken from the largest to the
smallest; among the open sequences that hold the piece under every constraint
the one with the best score wins: the smallest weighted norm of what would be
left (``"norm"``) or the largest weighted dot product of the piece with what is
left (``"dot"``). Only if none holds it, a sequence is opened.

Spark deals the pieces evenly into groups of ``GROUP`` and packs each group in a
task. Sequences left open are packed again as wholes, in groups, until their
number stops falling, so no task ever holds more than a group.

Defined results: a null text is an empty one and still holds the closing id;
repeated rows are packed one by one; ties go to the sequence opened first; an
empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Remembered, map_columns, written

GROUP = 8_192
CLOSING_ID = 1
LENGTH = 4_096
CACHED_BYTES = 64 << 20
STEMS = 200
# A point or comma beside another mark may be one token with it.
MARKS = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s].)|(?<=_.))").search
WEIGHTS = (1.0, 0.001, 0.001)
# A sequence filled to this share is closed after its first group.
CLOSED_AT = 0.999

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordIds:
    """Ids of texts by a tokenizer that drops white space, word by word.

    Such a tokenizer treats what stands between white space on its own, so the ids
    of a word are remembered as packed 32-bit numbers. Words of letters only,
    perhaps with a final mark, are most of the new ones: in lower case they pass
    the tokenizer's normalizer and its pattern unchanged, so its merges are
    applied to many of them at once, without those two steps.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.plain = Tokenizer.from_str(json.dumps(rules | {"normalizer": None}))
        self.plain.encode_special_tokens = True
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = rules["model"]["vocab"]
        mark = rules["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if mark:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.known = Remembered(CACHED_BYTES)

    @classmethod
    def of_process(cls, path: str) -> "WordIds":
        """The coder of this worker process: what it knows outlives a task."""
        state = vars(sys.modules.setdefault("footfall_worker", types.ModuleType("footfall_worker")))
        coders = state.setdefault("word_ids", {})
        if path not in coders:
            coders[path] = cls(path)
        return coders[path]

    @staticmethod
    def spaced(text: str) -> str:
        """The text with its words apart, in lower case where that can be settled at once."""
        # Python also splits at these four; they are no white space to a tokenizer.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return "\x1f" + text
        if MARKS(text) or "\u03a3" in text or "\u0130" in text or not is_normalized("NFC", text):
            return text
        # Case is folded letter by letter and a lone mark is a token of its own, so
        # both can be settled for the whole text: far fewer words differ.
        return text.lower().replace(",", " ,").replace(".", " .")

    def packed(self, texts: list[str | None]) -> list[bytes]:
        self.known.trim()
        ready = [self.spaced(t) if t else "" for t in texts]
        # A lead of \x1f marks the rare texts that are split here, at the other white space.
        odd = [i for i, t in enumerate(ready) if t[:1] == "\x1f"]
        plain = pa.array(["" if t[:1] == "\x1f" else t for t in ready], pa.large_string())
        split = pc.utf8_split_whitespace(plain)
        out = self.known.joined(self.known.places(split.values, self.learn), np.asarray(split.offsets))
        for i in odd:
            words = [w.decode() for w in texts[i].encode().split()]
            out[i] = b"".join(self.learn(words))
        return out

    def learn(self, words: list[str]) -> list[bytes]:
        known, stemmed, other = {"": b""}, [], []
        for w in words:
            mark = w[-1] if w and w[-1] in ",." else ""
            stem = w[:-1] if mark else w
            low = stem.lower()
            if low.isalpha() and (stem.isascii() or "\u03a3" not in stem and is_normalized("NFC", stem)):
                stemmed.append((w, low, mark))
            elif w:
                other.append(w)
        stems = list({low for _, low, _ in stemmed})
        parts = [stems[k : k + STEMS] for k in range(0, len(stems), STEMS)]
        # Few at a time, since the library's results are large.
        for at in range(0, len(parts), 50):
            some = parts[at : at + 50]
            for part, coded in zip(some, self.plain.encode_batch_fast([" ".join(p) for p in some], add_special_tokens=False)):
                ids = np.array(coded.ids, "<u4")
                cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                if len(cuts) == len(part):
                    raw = ids.tobytes()
                    known.update((x, raw[a:z]) for x, a, z in zip(part, [0, *cuts], cuts))
                else:
                    other += part
        other += list(",.")
        for at in range(0, len(other), 5_000):
            coded = self.tokenizer.encode_batch_fast(other[at : at + 5_000], add_special_tokens=False)
            known.update((w, np.array(c.ids, "<u4").tobytes()) for w, c in zip(other[at : at + 5_000], coded))
        known.update((w, known[low] + known[mark] if mark else known[low]) for w, low, mark in stemmed if w != low)
        return [known[w] for w in words]


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """Every text as ids and the closing id, cut into pieces of ``length`` ids."""
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def step(batches):
        words = WordIds.of_process(tokenizer_path)
        for b in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(b["doc_id"], words.packed(b["text"])):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
            yield out

    return map_columns(docs.select("doc_id", "text"), step, PIECES)


def best_fit(items: np.ndarray, capacity, weights=WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The bin of every item: vectors packed from large to small.

    An item that no empty bin could hold raises an error.
    """
    capacity = np.asarray(capacity, float)
    items = np.asarray(items, float).reshape(-1, len(capacity))
    if (items > capacity).any():
        raise ValueError("an item exceeds the capacity of a sequence")
    size, weights = items / capacity, np.asarray(weights, float)
    left = np.empty((max(1, len(items)), len(capacity)))
    share = np.empty_like(left)
    opened, out = 0, np.zeros(len(items), np.int64)
    live = np.empty(0, np.int64)
    for n, i in enumerate(np.lexsort((np.arange(len(items)), -(size * weights).sum(axis=1)))):
        if n % 256 == 0:
            live = live[left[live, 0] > 0] if n else live
        fits = live[(left[live] >= items[i]).all(axis=1)]
        if len(fits):
            if rule == "norm":
                score = -(weights * (share[fits] - size[i]) ** 2).sum(axis=1)
            else:
                score = (weights * share[fits] * size[i]).sum(axis=1)
            k = fits[score.argmax()]
        else:
            k, opened = opened, opened + 1
            left[k], share[k] = capacity, 1.0
            live = np.append(live, k)
        left[k] -= items[i]
        share[k] -= size[i]
        out[i] = k
    return out


def _vectors(length, documents, attention):
    return np.stack([np.asarray(length), np.asarray(documents), np.asarray(attention)], axis=1)


def _in_place(bins: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places without gaps within each bin, in row order."""
    order = np.argsort(bins, kind="stable")
    run = np.cumsum(length[order]) - length[order]
    first = np.r_[True, np.diff(bins[order]) > 0] if len(bins) else np.zeros(0, bool)
    base = np.maximum.accumulate(np.where(first, run, 0))
    out = np.empty(len(bins), np.int64)
    out[order] = run - base
    return out


def pack(
    pieces: DataFrame,
    tokens: int = LENGTH,
    documents: int = LENGTH,
    attention: int = LENGTH * LENGTH,
    weights=WEIGHTS,
    rule: str = "norm",
    group: int = GROUP,
) -> DataFrame:
    """Assign every piece a sequence and a place in it.

    ``pieces`` has the columns of ``token_pieces`` and should be cheap to read
    twice. The default capacities in documents and attention never bind a
    sequence of ``tokens`` ids.
    """
    capacity = (tokens, documents, attention)

    def grouped(df):
        return df.repartition(max(1, -(-df.count() // group)))

    def first(batches):
        rows = _gathered(batches, [f.split()[0] for f in PIECES.split(", ")])
        length = np.array(rows["length"], np.int64)
        bins = best_fit(_vectors(length, np.ones(len(length)), length**2), capacity, weights, rule)
        rows["sequence_id"] = (TaskContext.get().partitionId() << 32) + bins
        rows["offset"] = _in_place(bins, length)
        yield rows

    packed = written(map_columns(grouped(pieces), first, PACKED), "packed")
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.count("*").alias("documents"),
        F.sum(F.col("length") * F.col("length")).alias("attention"),
    )
    open_now = written(whole.where(F.col("length") < CLOSED_AT * tokens), "open")
    moves = None
    before, now = None, open_now.count()
    while now > 1 and now != before:

        def again(batches):
            rows = _gathered(batches, ["sequence_id", "length", "documents", "attention"])
            length = np.array(rows["length"], np.int64)
            vectors = _vectors(length, rows["documents"], rows["attention"])
            bins = best_fit(vectors, capacity, weights, rule)
            ids = np.array(rows["sequence_id"], np.int64)
            # The first member lends its number to the sequence it opens.
            lead = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(lead, bins, ids)
            rows["merged_id"], rows["shift"] = lead[bins], _in_place(bins, length)
            yield rows

        step = written(
            map_columns(
                grouped(open_now),
                again,
                "sequence_id long, length long, documents long, attention long, merged_id long, shift long",
            ),
            "moves",
        )
        one = step.select("sequence_id", "merged_id", "shift")
        moves = one if moves is None else (
            moves.alias("a").join(one.alias("b"), F.col("a.merged_id") == F.col("b.sequence_id"), "left").select(
                "a.sequence_id",
                F.coalesce("b.merged_id", "a.merged_id").alias("merged_id"),
                (F.col("a.shift") + F.coalesce("b.shift", F.lit(0))).alias("shift"),
            )
        )
        merged = step.groupBy(F.col("merged_id").alias("sequence_id")).agg(
            *[F.sum(c).alias(c) for c in ("length", "documents", "attention")]
        )
        open_now = written(merged.where(F.col("length") < CLOSED_AT * tokens), "open")
        before, now = now, open_now.count()
    if moves is None:
        return packed
    return packed.join(moves, "sequence_id", "left").select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("merged_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _gathered(batches, names) -> dict:
    """All rows of a task, which the grouping bounds."""
    rows = {k: [] for k in names}
    for b in batches:
        for k in names:
            rows[k].extend(b[k])
    return rows


def packed_documents(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Tokenize once, then pack: the pieces are written before they are counted."""
    return pack(written(token_pieces(docs, tokenizer_path), "pieces"), **how)

"""Token ids as raw files with a minimal perfect hash index over document keys.

A store is a folder. ``shard-N.ids`` holds the ids of documents one after another,
as little-endian numbers of two bytes (four, if the vocabulary needs them), after a
header; shards follow each other in ascending ``doc_id`` order. ``index-N.mph`` maps
the document keys of one hash bucket to their place: a cascade of bit arrays gives
each key a slot of its own in 0..n-1, and the slot's record holds a fingerprint, the
shard, the offset, the number of ids before the document, and its length. A key that
is not in the store fails the fingerprint, but for one in 2**32. ``manifest.json`` is
written last; a folder without it is no store.

Spark sorts the documents by range; a task encodes each range and streams it into a
shard. Order and content of a shard do not depend on the attempt, and files appear
under their name by a rename, so lost tasks can be run again. Hot ids are no problem:
equal ids are ordered by file and row of the input, and may spread over many shards.

Defined results: a null or empty text has the closing id only; a null ``doc_id`` is a
key like any other and comes first; rows that share an id are told apart by their
number among them (``copy``, from 0, in the order of the input files); strings of special tokens are
ordinary text; an empty table gives a store without documents; asking for a key that
is not there gives no row.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footfall.llm.common import Remembered, written
from footfall.session import scratch_path

END_ID = 0
SHARD_BYTES = 64 << 20  # of text
KEYS = 1_000_000  # per index bucket, on average
ROOM = 2.0  # bits per key and level
LEVELS = 200
OUT_BYTES = 8 << 20
CACHED_BYTES = 48 << 20

SHARD_MAGIC, INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
SHARD_HEADER = 16
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("start", "<u8"), ("n", "<u8")])

# White space differs at four controls between Python and the tokenizer; one of them
# serves as a separator, so texts that hold them are encoded whole.
UNSURE = "[\x1c-\x1f]"
JOINED = 200
BATCH_BYTES = 8 << 20
ENCODED_CHARS = 200_000


class ByteIds:
    """Ids of texts by a byte-level tokenizer, as packed numbers, word by word.

    A pre-token of the tokenizer's pattern never crosses a blank before a character
    that is not white space. Texts are cut there, and only words not met before are
    encoded. What is known is bounded in bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        def load():
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            return tokenizer

        self.tokenizer = load()
        # For words of letters only: each is one pre-token, so no pattern is needed.
        self.plain = load()
        self.plain.pre_tokenizer = Sequence(
            [Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.tokenizer.get_vocab()
        top = max([*vocabulary.values(), END_ID])
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.leads = np.zeros(top + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.known = Remembered(CACHED_BYTES)
        self.uncut = np.zeros(0, bool)

    @classmethod
    def of_process(cls, path: str) -> "ByteIds":
        """The coder of this worker process: what it knows outlives a task."""
        state = vars(sys.modules.setdefault("footfall_worker", types.ModuleType("footfall_worker")))
        coders = state.setdefault("byte_ids", {})
        if path not in coders:
            coders[path] = cls(path)
        return coders[path]

    def packed(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text (large strings; a null is an empty text)."""
        if self.known.trim():
            self.uncut = np.zeros(0, bool)
        texts = texts.fill_null("")
        unsure = pc.match_substring_regex(texts, UNSURE)
        sure = pc.if_else(unsure, "", texts) if pc.any(unsure).as_py() else texts
        # The separator is one of the unsure characters.
        split = pc.split_pattern(pc.replace_substring(sure, " ", "\x1f "), "\x1f")
        at = self.known.places(split.values, self.encoded)
        cuts = np.asarray(split.offsets)
        out = self.known.joined(at, cuts)
        fresh = self.known.words.slice(len(self.uncut)).to_pylist()
        self.uncut = np.append(self.uncut, [w[:1] == " " and (len(w) == 1 or w[1].isspace()) for w in fresh]).astype(bool)
        # A blank before white space is no place to cut: these texts go whole.
        again = set((np.searchsorted(cuts, np.flatnonzero(self.uncut[at]), side="right") - 1).tolist())
        again = sorted(again | set(np.flatnonzero(unsure.to_numpy(zero_copy_only=False)).tolist()))
        for i, ids in zip(again, self.encoded(texts.take(pa.array(again, pa.int64())).to_pylist())):
            out[i] = ids
        return out

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids by the library; words after a blank go many at once."""
        out: list[bytes] = [b""] * len(texts)
        letters, marked, other = [], [], []
        for k, t in enumerate(texts):
            led = t[:1] == " " and len(t) > 1 and not t[1].isspace()
            (other if not led else letters if t[1:].isalpha() else marked).append(k)
        for tokenizer, some in ((self.plain, letters), (self.tokenizer, marked)):
            parts = [some[k : k + JOINED] for k in range(0, len(some), JOINED)]
            joined = ("".join([texts[k] for k in part]) for part in parts)
            for part, ids in zip(parts, self.numbers(tokenizer, joined)):
                # The first token of each word shows where it begins.
                at = (self.kind.itemsize * np.flatnonzero(self.leads[ids])).tolist()
                if len(at) == len(part):
                    raw = ids.tobytes()
                    for k, a, z in zip(part, at, [*at[1:], len(raw)]):
                        out[k] = raw[a:z]
                else:
                    other += part
        for k, ids in zip(other, self.numbers(self.tokenizer, (texts[k] for k in other))):
            out[k] = ids.tobytes()
        return out

    def numbers(self, tokenizer, texts):
        """Ids of each text; few at a time, since the library's results are large."""
        held, size = [], 0
        for t in itertools.chain(texts, [None]):
            if held and (t is None or size + len(t) > ENCODED_CHARS):
                for coded in tokenizer.encode_batch_fast(held, add_special_tokens=False):
                    yield np.array(coded.ids, self.kind)
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)


# --- files


def opened(uri: str):
    """File system and path of a folder, on this machine or on an executor."""
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class _NewFile:
    """A file that gets its name only when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.draft = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.draft, self.path)
        except OSError:
            # Another attempt of the task was first; its bytes are the same.
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.draft)


# --- the hash index


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(doc_id: np.ndarray, absent: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes and a 32-bit fingerprint of every key, one row each."""
    doc = _mix(np.asarray(doc_id, np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    doc = np.where(absent, np.uint64(0x5851F42D4C957F2D), doc)
    number = _mix(np.asarray(copy, np.int64).view(np.uint64) + np.uint64(0xD1342543DE82EF95))
    first = _mix(doc + number)
    second = _mix((doc ^ (number << np.uint64(1))) * np.uint64(0xDA942042E4DD58B5))
    return np.stack([first, second, _mix(first ^ (second >> np.uint64(7))) >> np.uint64(32)])


def _place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    mixed = _mix(hashes[0] + hashes[1] * np.uint64(2 * level + 1))
    return ((mixed >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)


class HashIndex:
    """A minimal perfect hash function: a cascade of bit arrays with ranks.

    On each level a key that shares its bit with no other owns it; the others go on to
    the next, smaller one. The slot of a key is the number of owned bits before its own.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.uint64)
        self.ranks = (np.cumsum(ones) - ones).astype("<u4")

    @classmethod
    def build(cls, hashes: np.ndarray) -> "HashIndex":
        rest, sizes, words = hashes, [], [np.zeros(0, "<u8")]
        while rest.shape[1]:
            if len(sizes) == LEVELS:
                raise ValueError("two document keys have equal hashes")
            bits = 64 * max(1, int(np.ceil(ROOM * rest.shape[1] / 64)))
            at = _place(rest, len(sizes), bits).astype(np.int64)
            owned = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(owned, bitorder="little").view("<u8"))
            rest = rest[:, ~owned[at]]
        return cls(sizes, np.concatenate(words))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 or that of another key for one not indexed."""
        out = np.full(hashes.shape[1], -1, np.int64)
        todo = np.arange(hashes.shape[1])
        for level, bits in enumerate(self.sizes):
            at = _place(hashes[:, todo], level, bits).astype(np.int64) + self.base[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self.ranks[at >> 6] + before)[hit]
            todo = todo[~hit]
        return out

    def header(self, n: int) -> bytes:
        return INDEX_MAGIC + struct.pack(f"<QQ{len(self.sizes)}Q", n, len(self.sizes), *self.sizes)


def index_file(hashes: np.ndarray, records: np.ndarray) -> bytes:
    """Header, bit words, ranks, then one record per slot."""
    index = HashIndex.build(hashes)
    table = np.zeros(len(records), RECORD)
    table[index.slots(hashes)] = records
    return b"".join([index.header(len(table)), index.words.tobytes(), index.ranks.tobytes(), table.tobytes()])


def index_parts(raw: bytes) -> tuple[HashIndex, np.ndarray]:
    if raw[:8] != INDEX_MAGIC:
        raise ValueError("this is no index file")
    n, levels = struct.unpack_from("<QQ", raw, 8)
    sizes = list(struct.unpack_from(f"<{levels}Q", raw, 24))
    at, words = 24 + 8 * levels, sum(sizes) // 64
    index = HashIndex(sizes, np.frombuffer(raw, "<u8", words, at))
    return index, np.frombuffer(raw, RECORD, n, at + 12 * words)


def _keys(batch: pa.RecordBatch):
    doc = batch.column("doc_id")
    absent = doc.is_null().to_numpy(zero_copy_only=False)
    return key_hashes(
        doc.fill_null(0).to_numpy(zero_copy_only=False), absent, batch.column("copy").to_numpy(zero_copy_only=False)
    )


def _by(batches, name: str):
    """Record batches of one value of a column each; the rows are sorted by it."""
    held, value = [], None
    for batch in batches:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, z in zip(cuts, cuts[1:]):
            if a == z:
                continue
            if held and values[a] != value:
                yield value, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            value = values[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield value, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


# --- writing


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int")


def in_files(docs: DataFrame) -> DataFrame:
    """``doc_id, text, file, row``: rows with their fixed place in the files they come from."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select("doc_id", "text", *place)
    except AnalysisException:  # not a plain scan
        return written(docs.select("doc_id", "text"), "documents").select("doc_id", "text", *place)


def _lots(batch: pa.RecordBatch):
    """Ids and texts of a batch, of about ``BATCH_BYTES`` of text at a time."""
    docs, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_string())
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BATCH_BYTES, side="right")))
        yield docs.slice(a, z - a), texts.slice(a, z - a)
        a = z


def write_store(docs: DataFrame, tokenizer_path: str, folder: str, shard_bytes: int = SHARD_BYTES, keys: int = KEYS) -> DataFrame:
    """Encode ``docs``, write the store, and return its keys ``doc_id, copy``."""
    spark = docs.sparkSession
    width = ByteIds(tokenizer_path).kind.itemsize
    source = in_files(docs)
    rows, held = source.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(spark.sparkContext.defaultParallelism, -(-held // shard_bytes))
    order = ["doc_id", "file", "row"]
    ordered = source.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def stream(batches):
        shard, out, at, last, first, copy = TaskContext.get().partitionId(), None, SHARD_HEADER, None, None, 0
        coder = ByteIds.of_process(tokenizer_path)
        closing = np.array([END_ID], coder.kind).tobytes()
        for docs, texts in itertools.chain.from_iterable(map(_lots, batches)):
            if out is None:
                out = _NewFile(folder, f"shard-{shard:08d}.ids")
                out.write(SHARD_MAGIC + struct.pack("<Q", width))
                first = (docs[0].as_py(),)
            ids = coder.packed(texts)
            for x in ids:
                out.write(x + closing)
            copies, leads = [], []
            for doc in docs.to_pylist():
                copy = copy + 1 if last == (doc,) else 0
                last = (doc,)
                copies.append(copy)
                leads.append(last == first)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) + width
            offsets = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            columns = [docs, np.full(len(ids), shard, np.int32), offsets, sizes // width, copies, leads]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                names=["doc_id", "shard", "offset", "n", "copy", "lead"],
            )
        if out is not None:
            out.close()

    placed = written(
        ordered.mapInArrow(stream, "doc_id long, shard int, offset long, n long, copy long, lead boolean"), "placed"
    )
    # One row per shard from here on, until they are joined back.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("shard").agg(F.sum("n").alias("total")).select(
        "shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")
    )
    # The first id of a shard may have rows in earlier shards too.
    key = F.struct("doc_id")
    leads = placed.where("lead").select("shard", key.alias("lead_id")).distinct()
    counts = (
        placed.select("shard", key.alias("lead_id"))
        .join(leads.select("lead_id").distinct(), "lead_id", "left_semi")
        .groupBy("lead_id", "shard")
        .agg(F.count("*").alias("n"))
    )
    sofar = Window.partitionBy("lead_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select("lead_id", "shard", F.coalesce(F.sum("n").over(sofar), F.lit(0)).alias("carried"))
    facts = before.join(leads.join(carried, ["lead_id", "shard"]).select("shard", "carried"), "shard")
    buckets = max(1, -(-rows // keys))
    records = written(
        placed.join(facts, "shard").select(
            "doc_id",
            (F.col("copy") + F.when(F.col("lead"), F.col("carried")).otherwise(0)).alias("copy"),
            "shard",
            "offset",
            ((F.col("offset") - SHARD_HEADER) / width + F.col("before")).cast("long").alias("start"),
            "n",
        ),
        "records",
    )

    def build(batches):
        for bucket, batch in _by(batches, "bucket"):
            hashes = _keys(batch)
            table = np.zeros(batch.num_rows, RECORD)
            table["print"] = hashes[2]
            for name in ("shard", "offset", "start", "n"):
                table[name] = batch.column(name).to_numpy(zero_copy_only=False)
            out = _NewFile(folder, f"index-{bucket:08d}.mph")
            out.write(index_file(hashes, table))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    dealt = records.withColumn("bucket", _bucket(buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    indexed = dealt.mapInArrow(build, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if indexed != rows:
        raise RuntimeError(f"{indexed} of {rows} documents were indexed")
    manifest = _NewFile(folder, "manifest.json")
    manifest.write(json.dumps({"documents": rows, "buckets": buckets, "shards": shards, "width": width}).encode())
    manifest.close()
    return records.select("doc_id", "copy")


# --- reading


def read_manifest(folder: str) -> dict:
    fs, root = opened(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def fetched(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """``doc_id, copy, start, n, ids`` of the asked keys that the store holds.

    ``ids`` are little-endian 32-bit numbers. Keys go to the tasks of their index
    bucket, which find their places; these go to the tasks of their shards.
    """
    about = read_manifest(folder)
    buckets, shards, width = about["buckets"], about["shards"], about["width"]

    def find(batches):
        fs, root = opened(folder)
        bucket, index, table = None, None, None
        for batch in batches:
            for now, part in _by([batch], "bucket"):
                if now != bucket:
                    path = f"{root}/index-{now:08d}.mph"
                    if fs.get_file_info(path).type != pafs.FileType.File:
                        continue
                    with fs.open_input_stream(path) as f:
                        index, table = index_parts(f.read())
                    bucket = now
                hashes = _keys(part)
                slot = index.slots(hashes)
                got = table[np.maximum(slot, 0)]
                known = (slot >= 0) & (got["print"] == hashes[2])
                kept, got = part.filter(pa.array(known)), got[known]
                yield pa.RecordBatch.from_arrays(
                    [kept.column("doc_id"), kept.column("copy")]
                    + [pa.array(got[c].astype(np.int64)) for c in ("shard", "offset", "start", "n")],
                    names=["doc_id", "copy", "shard", "offset", "start", "n"],
                )

    asked = keys.select(F.col("doc_id").cast("long"), F.col("copy").cast("long")).withColumn("bucket", _bucket(buckets))
    places = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(
        find, "doc_id long, copy long, shard long, offset long, start long, n long"
    )

    def load(batches):
        fs, root = opened(folder)
        for batch in batches:
            for shard, part in _by([batch], "shard"):
                with fs.open_input_file(f"{root}/shard-{shard:08d}.ids") as f:
                    if f.read(8) != SHARD_MAGIC:
                        raise ValueError("this is no shard of ids")
                    offset = part.column("offset").to_numpy()
                    size = part.column("n").to_numpy() * width
                    a = 0
                    while a < len(offset):
                        # Neighbours in the file are read together, up to a bound.
                        z = a + 1
                        while z < len(offset) and offset[z] + size[z] - offset[a] <= OUT_BYTES:
                            z += 1
                        raw = f.read_at(int(offset[z - 1] + size[z - 1] - offset[a]), int(offset[a]))
                        ids = [
                            np.frombuffer(raw, f"<u{width}", s // width, o).astype("<u4").tobytes()
                            for o, s in zip((offset[a:z] - offset[a]).tolist(), size[a:z].tolist())
                        ]
                        cut = part.slice(a, z - a)
                        yield pa.RecordBatch.from_arrays(
                            [cut.column(c) for c in ("doc_id", "copy", "start", "n")] + [pa.array(ids, pa.binary())],
                            names=["doc_id", "copy", "start", "n", "ids"],
                        )
                        a = z

    return places.repartition(shards, "shard").sortWithinPartitions("shard", "offset").mapInArrow(
        load, "doc_id long, copy long, start long, n long, ids binary"
    )


class Reader:
    """Single documents of a store by a fixed number of small reads."""

    def __init__(self, folder: str):
        self.about = read_manifest(folder)
        self.fs, self.root = opened(folder)

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of a document, or None."""
        import xxhash

        # The engine's xxhash64 of two longs: the first hash seeds the second; nulls do not count.
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        signed = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", copy), seed)))[0]
        path = f"{self.root}/index-{signed % self.about['buckets']:08d}.mph"
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        hashes = key_hashes(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([copy]))
        with self.fs.open_input_file(path) as f:
            _, levels = struct.unpack("<QQ", f.read_at(16, 8))
            sizes = struct.unpack(f"<{levels}Q", f.read_at(8 * levels, 24))
            words_at, words = 24 + 8 * levels, sum(sizes) // 64
            base = 0
            for level, bits in enumerate(sizes):
                at = int(_place(hashes, level, bits)[0]) + base
                (word,) = struct.unpack("<Q", f.read_at(8, words_at + 8 * (at >> 6)))
                if word >> (at & 63) & 1:
                    (rank,) = struct.unpack("<I", f.read_at(4, words_at + 8 * words + 4 * (at >> 6)))
                    slot = rank + (word & ((1 << (at & 63)) - 1)).bit_count()
                    got = np.frombuffer(f.read_at(RECORD.itemsize, words_at + 12 * words + RECORD.itemsize * slot), RECORD)[0]
                    if got["print"] != hashes[2, 0]:
                        return None
                    return self._ids(got)
                base += bits
        return None

    def _ids(self, record) -> np.ndarray:
        width = self.about["width"]
        with self.fs.open_input_file(f"{self.root}/shard-{int(record['shard']):08d}.ids") as f:
            return np.frombuffer(f.read_at(int(record["n"]) * width, int(record["offset"])), f"<u{width}").astype("<u4")


def token_file_digests(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **how) -> DataFrame:
    """Write a store, read every document back by its key, and describe what was read."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "llm-id-store")
    keys = write_store(docs, tokenizer_path, folder, **how)
    return fetched(spark, folder, keys).select(
        "doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "copy"
    )

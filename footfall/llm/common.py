"""What the training-data operators share: Arrow mapping, hashing, connected parts.

Every operator reads the columns it needs by name, so extra columns of its input,
whatever they are called, never reach it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.session import scratch_path

# Python code sees so many rows or characters of text at once, one row at least.
BATCH_ROWS = 2_000
BATCH_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: a lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{label}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_columns(df: DataFrame, step: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """Run ``step`` over a partition as dictionaries of Python lists.

    ``step`` gets an iterator of column dictionaries (at most ``BATCH_ROWS`` rows
    and about ``BATCH_CHARS`` characters of ``text`` each) and yields such
    dictionaries (lists or numpy arrays) in the given schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    most, chars = BATCH_ROWS, BATCH_CHARS

    def run(batches):
        def lists():
            for batch in batches:
                columns = {f: batch.column(i).to_pylist() for i, f in enumerate(batch.schema.names)}
                texts, start, held = columns.get("text"), 0, 0
                for end in range(1, batch.num_rows + 1):
                    held += len(texts[end - 1] or "") if texts else 0
                    if held >= chars or end - start >= most or end == batch.num_rows:
                        yield {f: v[start:end] for f, v in columns.items()}
                        start, held = end, 0

        for out in step(lists()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, kind)


class Remembered:
    """Words met so far and what they became, in Arrow arrays bounded in bytes.

    Looking a batch's words up is one call; only words not met before reach Python.
    """

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes
        self.forget()

    def forget(self) -> None:
        self.words, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def trim(self) -> bool:
        """Start anew if the bound is passed; only between batches."""
        over = self.words.nbytes + self.values.nbytes > self.most_bytes
        if over:
            self.forget()
        return over

    def places(self, words: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """Where the words are among the known ones; ``learn`` gives the value of new ones."""
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return at.to_numpy()
        missing = words.filter(at.is_null())
        new, before = missing.unique(), len(self.words)
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = before + pc.index_in(missing, value_set=new).to_numpy()
        self.words = pa.concat_arrays([self.words, new])
        self.values = pa.concat_arrays([self.values, pa.array(learn(new.to_pylist()), pa.large_binary())])
        return at

    def joined(self, at: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The values at ``at``, put together between the cuts."""
        values = self.values.take(pa.array(at))
        ends = np.frombuffer(values.buffers()[1], np.int64)[cuts].tolist() if len(values) else [0] * len(cuts)
        data = memoryview(values.buffers()[2] or b"")
        return [bytes(data[a:z]) for a, z in zip(ends, ends[1:])]


def held_out(doc_id: str = "doc_id"):
    """The fixed fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_code(word: bytes) -> int:
    return zlib.crc32(word)


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over pairs ``u < v``: hang neighbours on the smallest one."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.join(least, "u")
    hung = hung.where(F.col("v") > F.col("u")) if larger else hung
    moved = hung.select(F.col("v").alias("a"), "m")
    if not larger:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), "m"))
    return moved.where(F.col("a") != F.col("m")).select(F.col("m").alias("u"), F.col("a").alias("v")).distinct()


def connected(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """``node, component_id`` for every node of the links ``u, v``.

    The smallest node reachable names the component. Alternating large and small
    star steps, each a map-side combined minimum and a join, so neither a node
    with very many links nor a large component meets in one task. Every round is
    written to the shared folder.
    """
    own = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    state, before = written(own, f"{label}-links"), None
    for _ in range(most_rounds):
        state = written(_stars(_stars(state, True), False), f"{label}-links")
        now = state.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if before is not None and tuple(now) == tuple(before):
            return state.select(F.col("v").alias("node"), F.col("u").alias("component_id")).unionByName(
                state.select(F.col("u").alias("node"), F.col("u").alias("component_id")).distinct()
            )
        before = now
    raise RuntimeError("links did not settle")

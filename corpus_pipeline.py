"""A corpus pipeline of the training-data operators: filter, dedup, redact, pack.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table; each is written
and read back before the next one starts. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import neighbours, packing, pii, simhash, suffixes
from footfall.llm.common import read, written

# Passages of over 50 words repeat in full: 51 words and their blanks have this many
# bytes at least in most of what is written, so shorter repeats are left alone.
PASSAGE_BYTES = 240

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that similar labelled texts vote good."""
    return neighbours.kept_good(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group of near copies stays: that of the smallest id.

    Rows that share an id are one document; the longest text of that id stays, once.
    Rows without an id take part under a name made of their text, above 2**62, so that
    their copies are merged too and a row with a smaller id goes before them.
    """
    name = F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)))
    rows = docs.select(*COLUMNS, name.alias("name"))
    found = simhash.near_duplicates(rows.select(F.col("name").alias("doc_id"), "text"), shingle=4, most=4)
    # One row per name, counted map-side: those that go, and those on several rows.
    marks = written(
        found.groupBy(F.col("doc_id").alias("name"))
        .agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
        .where("name <> component_id OR n > 1"),
        "near-marks",
    )
    single = rows.join(marks.select("name").hint("shuffle_hash"), "name", "left_anti").select(*COLUMNS)
    # Written, so that Spark can split a name on many rows; then merged map-side.
    several = marks.where("name = component_id").select("name")
    repeated = written(rows.join(several.hint("shuffle_hash"), "name", "left_semi"), "near-repeated")
    order = (-F.coalesce(F.octet_length("text"), F.lit(-1)), F.xxhash64(*COLUMNS), F.xxhash64(F.lit(1), *COLUMNS))
    best = repeated.groupBy("name").agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *COLUMNS)).alias("best"))
    return single.unionByName(best.select(*[F.col(f"best.{c}").alias(c) for c in COLUMNS]))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every byte of passages of ``PASSAGE_BYTES`` that occur more than once.

    A cut may fall inside a character; what is left of one is dropped.
    """
    carried = ("lang", "source")
    found = suffixes.deduplicated(docs, length=PASSAGE_BYTES, carry=carried, as_text=True)
    return found.select(
        "doc_id",
        "text",
        *carried,
        F.length("text").cast("long").alias("n_chars"),
    )


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redacted(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_unique),
    ("suffix-array dedup", unrepeated),
    ("PII", private),
    ("best-fit packing", packed),
]

# No SQL: votes, components and trained fields are beyond it; tests compare the
# stages with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""One query per operator over its whole table, with production settings."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import (
    bpe,
    chat,
    forest,
    idstore,
    licences,
    negatives,
    neighbours,
    packing,
    pii,
    rules,
    simhash,
    suffixes,
    whitening,
)
from footfall.llm.common import read


def op1_personal_data(spark, sf_dir):
    return pii.found_spans(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_neighbour_quality(spark, sf_dir):
    return neighbours.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_projection_forest(spark, sf_dir):
    return forest.near_vectors(read(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark, sf_dir):
    return suffixes.deduplicated(read(spark, sf_dir, "documents"), passage=corpus_pipeline.PASSAGE_BYTES)


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, most=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_role_repair(spark, sf_dir):
    return chat.repaired(read(spark, sf_dir, "conversations"))


def op8_byte_bpe(spark, sf_dir):
    return bpe.token_digests(
        read(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op9_best_fit(spark, sf_dir):
    return packing.packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_licences(spark, sf_dir):
    return licences.matched(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_id_store(spark, sf_dir):
    return idstore.token_file_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_whitening(spark, sf_dir):
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_personal_data,
    op2_quality_rules,
    op3_neighbour_quality,
    op4_projection_forest,
    op5_suffix_dedup,
    op6_simhash,
    op7_role_repair,
    op8_byte_bpe,
    op9_best_fit,
    op10_licences,
    op11_hard_negatives,
    op12_id_store,
    op13_whitening,
)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op10_licences": licences.matched_sql(), "op11_hard_negatives": negatives.mined_sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

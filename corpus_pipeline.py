"""The corpus pipeline: from ``documents`` to packed token windows, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of ``docs``. ``run``
writes each result as Parquet to the shared folder and reads it again as the next stage's documents, so a stage that
is lost is repeated from the files of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import decontaminate, language, line_chunks, near_text, packing
from wakeline.llm.common import table
from wakeline.session import stage

LEAST_CERTAINTY = 0.4  # mean of each word's largest probability, in whatever language
NEAR_PERCENT = 80  # similarity of word shingles that links two documents
NEAR_BANDING = (25, 5)  # misses a pair of exactly 0.8 with probability 5e-5; the operator's own 21 x 6 with 1.7e-3
VOCABULARY = "byte_bpe_50k.json"


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in recognisable languages, one or several: those without letters or whose words are of no known language go."""
    model = language.train(language.training_sample(docs, "doc_id", "text", "lang"))
    found = language.identify(docs, model)
    if model is None:  # nothing to learn from, nothing to reject by
        return docs
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("certainty") >= LEAST_CERTAINTY)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of two or more lines that an earlier place holds; documents of which nothing is left go."""
    found = line_chunks.remove_repeated_chunks(docs).where("NOT (n_removed > 0 AND kept = '')")
    columns = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.withColumns({c: v for c, v in columns.items() if c in docs.columns}).select(*docs.columns)


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash are listed."""
    listed = found.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_hash"))
    return docs.join(listed, same, "left_anti")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; exact repeats of its row go too, rows without id stay."""
    kept = _without(docs, near_text.near_duplicates(docs, percent=NEAR_PERCENT, banding=NEAR_BANDING).where("NOT kept"))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("n"))
    if repeated.where("n > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(kept.where("doc_id IS NULL"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 1024 tokens, with their ids as little-endian 32-bit integers."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("minhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmarks),
    ("packing", packed),
]

# Learned language labels and a tokenizer's ids are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

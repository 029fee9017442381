"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality_rules
from lodegraph.llm.common import discard, materialise, read
from lodegraph.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share this many of 100 of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.quality_rules(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs and of single lines go; so does a document of which nothing is left."""
    out = line_dedup.line_dedup(docs, longest_runs=False).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; documents without an id stay."""
    found = near_dedup.near_dedup(docs, size=SHINGLE, percent=PERCENT)
    return docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded_sha256, the digest of what they decode to."""
    path, pattern = vocabulary()
    encoded = byte_bpe.encode_and_decode(docs.select(*COLUMNS), path, pattern)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", leaks), ("encoding", tokens)]

#: Prefix doubling, components, edit matching and encoding are beyond SQL on these tables; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Samples of questions with their evidence, and passages of verbalised corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = """id string, question string, answer string, level string, type string,
supporting_facts struct<title:array<string>,sent_id:array<long>,text:array<string>>, context struct<title:array<string>,sentences:array<array<string>>>"""
PARAGRAPHS = "id string, question string, answer string, paragraphs array<struct<title:string,paragraph:string>>"
PASSAGES = "passage_id string, text string, entities array<string>, triple array<string>, subject string"


def _read(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def fact_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(question_id, question, answer, level, type, k, title, sent_id, sentence) of questions whose k-th fact is named by title and sentence number.

    The sentence comes from the question's own context, of a title given twice the last; without a context from the fact. A file is a JSON list, or a line a question.
    """
    raw = _read(spark, path, FACTS, lines)
    facts = F.posexplode(F.arrays_zip("supporting_facts.title", "supporting_facts.sent_id", F.coalesce("supporting_facts.text", F.array().cast("array<string>")).alias("text"))).alias("k", "f")
    each = raw.select("id", "question", "answer", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("type", F.lit("")).alias("type"), "context", facts)
    titles = F.filter(F.arrays_zip("context.title", "context.sentences"), lambda c: c["title"] == F.col("f.title"))
    sentence = F.get(F.try_element_at(titles, F.lit(-1))["sentences"], F.col("f.sent_id").cast("int"))
    return each.select(F.col("id").alias("question_id"), "question", "answer", "level", "type", F.col("k").cast("long").alias("k"), F.col("f.title").alias("title"), F.col("f.sent_id").alias("sent_id"), F.when(F.col("context").isNull(), F.coalesce("f.text", F.lit(""))).otherwise(sentence).alias("sentence"))


def paragraph_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(question_id, question, answer, k, title, paragraph); a question without paragraphs has one row with nulls."""
    raw = _read(spark, path, PARAGRAPHS, lines)
    return raw.select(F.col("id").alias("question_id"), "question", "answer", F.posexplode_outer("paragraphs").alias("k", "p")).select("question_id", "question", "answer", F.col("k").cast("long").alias("k"), "p.title", "p.paragraph")


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(passage_id, text, entities, triple, subject), a line a passage; triple and subject null where the corpus has none."""
    return _read(spark, path, PASSAGES, True)

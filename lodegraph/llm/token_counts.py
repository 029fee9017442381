"""Token counts: the exact histogram of encoded lengths, and what suffix sums of it answer.

A document counts only by its length, so (length, documents) is the whole
aggregate: it merges on the map side and has at most as many rows as the longest
document has tokens. Suffix sums over it give, for every context limit at once,
how many documents exceed it, how many tokens remain if all are cut at it, and
how many chunks of it they make. The sums run within blocks of BLOCK lengths in
parallel; a block's own total is all that crosses to the others.

Defined cases: a null text counts as an empty one, of length 0; repeated rows
count as often as they stand there; an empty table gives an empty histogram; the
other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.byte_bpe import read_ranks
from lodegraph.llm.common import materialise

#: Lengths to a block of the suffix sums.
BLOCK = 512


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def lengths(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens long: the encoded length of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("n_tokens", T.LongType())]))


def histogram(lens: DataFrame) -> DataFrame:
    """n_tokens, n_docs: how many rows have each length."""
    return lens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit L:

    n_docs of this length; docs_within and docs_over of at most and of more than
    L tokens; tokens_within, the tokens of those within; tokens_truncated, all
    tokens if every document is cut at L; quantile, the share of documents within.
    """
    own = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_t"), F.floor(F.col("n_tokens") / BLOCK).cast("long").alias("_b"))
    blocks = own.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    # one row for each BLOCK lengths: the longest text, not the number of texts, bounds this window
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    over_all = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("_b", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("_bd", "_bt")], *[F.sum(c).over(over_all).alias(f"{c}_all") for c in ("_bd", "_bt")])
    w = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    joined = own.join(blocks, "_b").select("n_tokens", "n_docs", "_bd_all", "_bt_all", *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"{a}_after")).alias(n) for c, a, n in (("n_docs", "_bd", "docs_over"), ("_t", "_bt", "_over"))])
    return joined.select(
        "n_tokens",
        "n_docs",
        (F.col("_bd_all") - F.col("docs_over")).alias("docs_within"),
        "docs_over",
        (F.col("_bt_all") - F.col("_over")).alias("tokens_within"),
        (F.col("_bt_all") - F.col("_over") + F.col("n_tokens") * F.col("docs_over")).alias("tokens_truncated"),
        ((F.col("_bd_all") - F.col("docs_over")) / F.col("_bd_all")).alias("quantile"),
    )


def at_limits(table: DataFrame, wanted: list[int]) -> DataFrame:
    """Of what `limits` returned, the answers for any limits: the row of the largest length that is no longer, its truncated total put right for the limit."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in wanted], "context_limit long")
    near = F.broadcast(asked).join(table, table["n_tokens"] <= asked["context_limit"], "left").groupBy("context_limit").agg(F.max(F.struct("n_tokens", "docs_within", "docs_over", "tokens_within")).alias("r"))
    all_docs = table.agg(F.sum("n_docs").alias("_all"))
    return near.join(F.broadcast(all_docs)).select(
        "context_limit",
        F.coalesce("r.docs_within", F.lit(0)).alias("docs_within"),
        F.coalesce("r.docs_over", "_all", F.lit(0)).alias("docs_over"),
        (F.coalesce("r.tokens_within", F.lit(0)) + F.col("context_limit") * F.coalesce("r.docs_over", "_all", F.lit(0))).alias("tokens_truncated"),
    )


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """What `limits` says of docs. The texts are encoded once; the histogram, a row for each length, is kept and read twice."""
    return limits(materialise(histogram(lengths(docs, vocabulary, pattern, text_col))))

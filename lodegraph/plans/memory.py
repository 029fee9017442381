"""Memory slots of keys: ragged lists of vectors with a digest of their contents that doesn't depend on order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def digests(slots: DataFrame) -> DataFrame:
    """(qid, n, digest) of slots (qid, slot, vec): SHA-256 of a key's vectors in order of their slots."""
    written = F.concat_ws(",", F.transform("vec", lambda x: F.hex(x.cast("double").cast("string").cast("binary"))))
    one = slots.select("qid", F.struct("slot", F.sha2(written, 256).alias("h")).alias("x"))
    return one.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda s: s["h"]), ""), 256).alias("digest"))


def content_hash(slots: DataFrame) -> str:
    """One digest of all keys: the XOR of their hashed digests, and their number."""
    row = digests(slots).agg(F.bit_xor(F.xxhash64("qid", "digest")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{(row.x or 0) & (2**64 - 1):016x}-{row.n}"


def save(slots: DataFrame, path: str, meta: dict) -> dict:
    """Vectors of one length only; the manifest holds it and the content's hash."""
    sizes = [r[0] for r in slots.select(F.size("vec")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"vectors of lengths {sizes}")
    slots.write.mode("overwrite").parquet(f"{path}/slots")
    held = {**meta, "width": sizes[0], "content": content_hash(slots)}
    slots.sparkSession.createDataFrame([(json.dumps(held, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return held


def load(spark: SparkSession, path: str, needed: tuple[str, ...] = ("width", "content")) -> DataFrame:
    """Refuses a manifest that lacks a key, and contents that it doesn't match."""
    held = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if missing := [k for k in needed if k not in held]:
        raise ValueError(f"the manifest lacks {missing}")
    slots = spark.read.parquet(f"{path}/slots")
    if content_hash(slots) != held["content"]:
        raise ValueError("the slots aren't those of the manifest")
    return slots


def padded(slots: DataFrame, width: int, most: int) -> DataFrame:
    """(qid, bank): each key's first `most` vectors, filled up with zero vectors."""
    w = Window.partitionBy("qid").orderBy("slot")
    first = slots.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    bank = F.transform(F.sort_array(F.collect_list(F.struct("_k", "vec"))), lambda x: x["vec"])
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return first.groupBy("qid").agg(bank.alias("b")).select("qid", F.concat("b", F.array_repeat(zero, F.lit(most) - F.size("b"))).alias("bank"))

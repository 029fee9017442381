"""Shared pieces of the training-data operators: reading, durable intermediates, row keys, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.operators.durable import discard, shared_folder  # noqa: F401
from lodegraph.operators.durable import kept as materialise  # noqa: F401

#: A word of the contracts: a run of anything but space and the five ASCII controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, prefix: str = "_") -> str:
    """A beginning that no column's name of df has, for columns of one's own."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: A key of more than one in SHARE rows is hot, so at most SHARE keys are; a hot key's rows are dealt to SALTS tasks.
SHARE, SALTS = 1000, 64


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined on keys with groups, which has a row for each key and in column n the number of its rows. Hot keys are split.

    groups is read three times, so it should be materialised.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * SHARE > total
    hot = groups.where(is_hot).select(*keys, F.lit(SALTS).alias("_salts"))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt")
    dealt = rows.join(F.broadcast(hot), keys, "left").select(*rows.columns, salt)  # fewer than SHARE rows
    copies = groups.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def frequent(counted: DataFrame, n: str, held: int, size: Column | None = None, held_size: int = 0) -> tuple[int, bool]:
    """The least power of two so that at most `held` rows of counted have n or more, and, if size is given, held_size of it; and whether these are all rows."""
    classes = counted.groupBy(F.floor(F.log2(n)).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.lit(0) if size is None else size).alias("size"))
    least, rows, total = 63, 0, 0
    for r in classes.orderBy(F.desc("k")).collect():  # 63 rows at most
        rows, total = rows + r["rows"], total + r["size"]
        if rows > held or total > held_size:
            return (2**least if least < 63 else 2**63 - 1), False
        least = r["k"]
    return (2**least if least < 63 else 2**63 - 1), True


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also if body's own functions use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def row_key(*cols: str):
    """A 64-bit key that tells apart rows of one id with different contents; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def order_key(col: str):
    """The id as an ordering key: a null id comes after every other."""
    return F.coalesce(F.col(col).cast("long"), F.lit(2**63 - 1))


def with_columns_schema(df: DataFrame, drop: list[str], add: list[tuple[str, T.DataType]]) -> tuple[DataFrame, T.StructType]:
    """df without the columns that the operator is about to write, and the schema with them appended."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in drop])
    return kept, T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in add]])


def map_in_arrow(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) whatever the columns are called: Spark's own takes a dot in a name for a field of a struct."""
    names, wanted = list(df.columns), schema.names
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batch.rename_columns(names) for batch in batches):
            yield out.rename_columns(numbered.names)

    return plain.mapInArrow(renamed, numbered).toDF(*wanted)


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    arrays, names = [*batch.columns, *columns.values()], [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)

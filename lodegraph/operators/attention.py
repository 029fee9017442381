"""Attention as joins and mergeable sums: message passing over a typed graph, and gated attention of positions to a bank of slots.

A softmax over many rows is three numbers that merge: the largest score, the sum of exponentials below it, and
the weighted sum of values. Rows are sorted by what they go to, merged within a task, and only
one merged row for each destination and task goes on; a destination with more than a thousandth of
all edges is dealt over tasks first, so a hub is no task's burden. Parameters are small dense arrays that come with the call; a layer
is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.durable import kept

#: A destination of more than one in SHARE edges is dealt over SALTS tasks; fewer than SHARE are.
SHARE, SALTS = 1000, 32
SLOPE = 0.2


class Layer(NamedTuple):
    """weight (relations, in, out), source and target (heads, out / heads), bias (out)."""

    weight: np.ndarray
    source: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def scores(self, side: np.ndarray) -> np.ndarray:
        """(relations, in, heads): what a node's vector gives to an edge's score."""
        r, i, _ = self.weight.shape
        return (self.weight.reshape(r, i, *side.shape) * side).sum(-1)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def arrays(m: np.ndarray) -> pa.Array:
    n, k = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k) if k else np.zeros(n + 1), pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1), pa.float64()))


class Sums(NamedTuple):
    """Of each key: the largest score of each head, the sum of exponentials below it, and values weighed by them."""

    key: list
    top: np.ndarray
    sum: np.ndarray
    value: np.ndarray

    def merged(self) -> Sums:
        """Neighbouring rows of one key become one."""
        if not self.key:
            return self
        new = np.array([True, *[a != b for a, b in zip(self.key, self.key[1:], strict=False)]])
        at, first = np.cumsum(new) - 1, np.flatnonzero(new)
        top = np.maximum.reduceat(self.top, first)
        scale = np.exp(self.top - top[at])
        width = self.value.shape[1] // self.top.shape[1]
        return Sums([self.key[i] for i in first], top, np.add.reduceat(self.sum * scale, first), np.add.reduceat(self.value * np.repeat(scale, width, axis=1), first))

    def joined(self, more: Sums) -> Sums:
        return Sums(self.key + more.key, *[np.concatenate(x) for x in zip(self[1:], more[1:], strict=True)])

    def cut(self, a: int, b: int) -> Sums:
        return Sums(self.key[a:b], *[x[a:b] for x in self[1:]])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.key, pa.string()), arrays(self.top), arrays(self.sum), arrays(self.value)], names=["key", "top", "sum", "value"])


SUMS = "key string, top array<double>, sum array<double>, value array<double>"


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, merged; the last key of a batch waits for the next one."""
    open_: Sums | None = None
    for b in batches:
        if b.num_rows:
            rows = Sums(b.column(0).to_pylist(), *[matrix(b.column(k)) for k in (1, 2, 3)])
            rows = (rows if open_ is None else open_.joined(rows)).merged()
            open_ = rows.cut(len(rows.key) - 1, len(rows.key))
            if len(rows.key) > 1:
                yield rows.cut(0, len(rows.key) - 1).batch()
    if open_ is not None:
        yield open_.batch()


def softmax_sums(rows: DataFrame) -> DataFrame:
    """SUMS of rows (key, top, sum, value), one for each key. A row that is no sum yet has its score, ones, and its value."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("t"))
    hot = kept(sizes.join(F.broadcast(total)).where(F.col("n") * SHARE > F.col("t")).select("key", F.lit(SALTS).alias("_salts")))  # fewer than SHARE rows; one row
    salt = F.pmod(F.xxhash64("top", "value"), F.coalesce("_salts", F.lit(1))).alias("_salt")
    dealt = rows.join(F.broadcast(hot), "key", "left").select("key", "top", "sum", "value", salt)
    once = dealt.repartition("key", "_salt").sortWithinPartitions("key").select("key", "top", "sum", "value").mapInArrow(_merging, SUMS)
    return once.repartition("key").sortWithinPartitions("key").mapInArrow(_merging, SUMS)


def _projected(nodes: DataFrame, uses: DataFrame, weight: np.ndarray, scores: np.ndarray, values: bool) -> DataFrame:
    """(node_id, rel, score, value) for uses (node_id, rel): the vector times the relation's matrices."""
    kind = "node_id string, rel int, score array<double>" + (", value array<double>" if values else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rel, h = b.column(1).to_numpy(zero_copy_only=False), matrix(b.column(2))
            score, value = np.zeros((len(rel), scores.shape[2])), np.zeros((len(rel), weight.shape[2] if values else 0))
            for r in np.unique(rel):
                own = rel == r
                score[own] = h[own] @ scores[r]
                if values:
                    value[own] = h[own] @ weight[r]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), arrays(score), *([arrays(value)] if values else [])], names=["node_id", "rel", "score", *(["value"] if values else [])])

    return uses.distinct().join(nodes, "node_id").select("node_id", "rel", "h").mapInArrow(run, kind)


def passed(nodes: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """(node_id, h): one round of message passing. nodes (node_id string, h array<double>, once each), edges (src, rel int, dst), a bag.

    The score of an edge is the sum of its ends' scores under its relation, by head, damped by SLOPE below zero; a node takes the softmax-weighted sum
    of its sources' vectors under their relations, plus the bias, nothing below zero. A node that no edge leads to has the bias alone. Edges with an end outside of nodes count for nothing.
    """
    heads = layer.source.shape[0]
    sources = _projected(nodes, edges.select(F.col("src").alias("node_id"), "rel"), layer.weight, layer.scores(layer.source), True).select(F.col("node_id").alias("src"), "rel", F.col("score").alias("_s"), "value")
    targets = _projected(nodes, edges.select(F.col("dst").alias("node_id"), "rel"), layer.weight, layer.scores(layer.target), False).select(F.col("node_id").alias("dst"), "rel", F.col("score").alias("_t"))
    score = F.zip_with("_s", "_t", lambda a, b: F.when(a + b > 0, a + b).otherwise((a + b) * SLOPE))
    ones = F.array(*[F.lit(1.0)] * heads)
    rows = kept(edges.select("src", "rel", "dst").join(sources, ["src", "rel"]).join(targets, ["dst", "rel"]).select(F.col("dst").alias("key"), score.alias("top"), ones.alias("sum"), "value"))
    bias = F.array(*[F.lit(float(x)) for x in layer.bias])
    width = len(layer.bias) // heads
    mean = F.transform("value", lambda x, i: x / F.get("sum", F.floor(i / width).cast("int")))
    positive = lambda v: F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    found = softmax_sums(rows).select(F.col("key").alias("node_id"), positive(F.zip_with(mean, bias, lambda x, b: x + b)).alias("h"))
    return nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("h", positive(bias)).alias("h"))


def product(vector: str, weight: np.ndarray, bias: np.ndarray) -> Column:
    """vector times weight (in, out) plus bias, as an expression over a small matrix."""
    rows = [F.array(*[F.lit(float(x)) for x in column]) for column in weight.T]
    return F.array(*[F.aggregate(F.zip_with(vector, r, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) + F.lit(float(b)) for r, b in zip(rows, bias, strict=True)])


def encoded(nodes: DataFrame, edges: DataFrame, layers: list[Layer], weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(node_id, h): the layers one after the other, plus the first vectors by a linear map. Without any edge the linear map alone."""
    base = nodes.select("node_id", product("h", weight, bias).alias("base"))
    if edges.isEmpty():
        return base.withColumnRenamed("base", "h")
    state = nodes.select("node_id", "h")
    for layer in layers:
        state = kept(passed(state, edges, layer))
    return state.join(base, "node_id").select("node_id", F.zip_with("h", "base", lambda x, y: x + y).alias("h"))


class Gate(NamedTuple):
    """query (model, model), key and value (slot, model), out (model, model), each applied to rows from the right; gain and shift of the norm; heads; alpha, closed at 0."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    gain: np.ndarray
    shift: np.ndarray
    heads: int
    alpha: float


def gated_attention(states: DataFrame, bank: DataFrame, chunk: Column, gate: Gate) -> DataFrame:
    """states (seq, pos, h) with h + tanh(alpha) * attention, and `contribution`, the ratio of the two parts' lengths (0 for a zero h).

    bank (seq, chunk, slot, e): what was retrieved for a chunk. chunk: the chunk whose slots a position attends to, null before there is one;
    a position without slots stays as it is. Every pair of a position and a slot of its chunk is one row until it is merged, so a bank may be of any size.
    """
    model, heads = gate.query.shape[0], gate.heads
    width = model // heads

    def normed(h: np.ndarray) -> np.ndarray:
        away = h - h.mean(1, keepdims=True)
        return away / np.sqrt((away**2).mean(1, keepdims=True) + 1e-5) * gate.gain + gate.shift

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, e = normed(matrix(b.column(1))) @ gate.query, matrix(b.column(2))
                score = ((q * (e @ gate.key)).reshape(-1, heads, width)).sum(-1) / np.sqrt(width)
                yield Sums(b.column(0).to_pylist(), score, np.ones_like(score), e @ gate.value).batch()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h, total, value = (matrix(b.column(k)) for k in (2, 3, 4))
                more = np.tanh(gate.alpha) * ((value / np.repeat(total, width, axis=1)) @ gate.out)
                size = np.linalg.norm(h, axis=1)
                share = np.divide(np.linalg.norm(more, axis=1), size, out=np.zeros_like(size), where=size > 0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), arrays(h + more), pa.array(share)], names=["seq", "pos", "h", "contribution"])

    at = states.withColumn("chunk", chunk)
    name = F.concat_ws(":", F.col("seq").cast("string"), F.col("pos").cast("string")).alias("key")
    rows = at.join(bank.select("seq", "chunk", "e"), ["seq", "chunk"]).select(name, "h", "e").mapInArrow(pairs, SUMS)
    found = softmax_sums(kept(rows))
    kinds = f"seq {states.schema['seq'].dataType.simpleString()}, pos {states.schema['pos'].dataType.simpleString()}, h array<double>, contribution double"
    own = at.select("seq", "pos", "h", name)
    changed = own.join(found, "key").select("seq", "pos", "h", "sum", "value").mapInArrow(added, kinds)
    return own.join(found.select("key"), "key", "left_anti").select("seq", "pos", "h", F.lit(0.0).alias("contribution")).unionByName(changed)

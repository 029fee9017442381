"""Centroid clustering with exact integers, each round filtered through ball trees.

Vectors become integers once. They are dealt into blocks, and each block gets a metric tree: a ball stores its
centre, its radius, the number of its vectors, their integer sum and the sum of their squares. Blocks are written once and read by
every round. In a round a ball with distances d to the centroids and radius r lies wholly at centroid j if
d_j + r < d_i - r for all others i; then its stored sum and count go to j at once. Otherwise the centroids that cannot be
the nearest to any of its vectors are left out below it, and the search descends, at leaves to
exact integer distances. Only count, sum and inertia of each cluster leave a block; they merge in Spark, and a round's
result is as many rows as there are clusters. Distances to balls are floating point with a margin; all that decides a tie is exact.

Defined cases: a vector that is null, hasn't `dims` components, or has a null or non-finite one is left out; repeated rows count as often as they stand
there; a vector without an id starts a cluster only after all others; fewer vectors than k give as many clusters; ties go to the smaller number;
empty clusters keep their centroid; an empty table gives an empty one; other columns play no part. A component of over LARGEST, for whose distances a long has no room, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegraph.llm.common import discard, materialise

#: Vectors of a block, and of a leaf.
BLOCK, LEAF = 4096, 16
#: The largest absolute value of a component: the squared distance of two vectors of 128 components fits a long.
LARGEST = 2**27
#: What a distance in floating point may be off by, as a share and at least.
SHARE, LEAST = 1e-9, 1e-6

TREES = "ids array<long>, points binary, ball binary"


def integers(vec_col: str, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component as an array of long; null where the vector has another length, a null or a non-finite component."""
    v = F.col(vec_col)
    sound = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(sound, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Balls(NamedTuple):
    """A tree over points, which stand in its order: ball i holds points first[i] to last[i]; left[i] and left[i] + 1 are its halves, 0 for a leaf.

    Its sum of squares is high * 2**32 + low.
    """

    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    centre: np.ndarray
    total: np.ndarray
    high: np.ndarray
    low: np.ndarray

    def pack(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("n", pa.int64()), ("dims", pa.int64()), *[(f, pa.binary()) for f in self._fields]])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array([len(self.first)]), pa.array([self.centre.shape[1]]), *[pa.array([x.tobytes()]) for x in self]], names=["n", "dims", *self._fields]))
        return sink.getvalue().to_pybytes()

    @staticmethod
    def unpack(data: bytes) -> Balls:
        row = pa.ipc.open_stream(data).read_all().to_pylist()[0]
        kinds = dict(zip(Balls._fields, (np.int64, np.int64, np.int64, np.float64, np.float64, np.int64, np.int64, np.int64), strict=True))
        return Balls(*[np.frombuffer(row[f], kinds[f]).reshape((row["n"], row["dims"]) if f in ("centre", "total") else row["n"]) for f in Balls._fields])


def halves(points: np.ndarray) -> tuple[int, int]:
    """The sum of all squares as two longs, which a single one may not hold."""
    own = (points * points).sum(1)
    return int((own >> 32).sum()), int((own & (2**32 - 1)).sum())


def grown(points: np.ndarray) -> tuple[np.ndarray, Balls]:
    """Order of the points and the tree over them. A ball is halved between two vectors far from each other; equal vectors are one leaf."""
    order, rows, todo = np.arange(len(points)), [], [(0, len(points))]
    at = 0
    while at < len(todo):
        a, b = todo[at]
        own = points[order[a:b]]
        total, real = own.sum(0), own.astype(np.float64)
        centre = total / (b - a)
        away = np.sqrt(((real - centre) ** 2).sum(1))
        radius, left = away.max() * (1 + SHARE) + LEAST, 0
        if b - a > LEAF and away.max() > 0:
            one = real[away.argmax()]
            to_one = ((real - one) ** 2).sum(1)
            nearer = to_one - ((real - real[to_one.argmax()]) ** 2).sum(1)
            ranked = np.argsort(nearer, kind="stable")
            cut = int((nearer < 0).sum())
            if 0 < cut < b - a and (to_one.max() > 0):
                order[a:b], left = order[a:b][ranked], len(todo)
                todo += [(a, a + cut), (a + cut, b)]
        rows.append((a, b, left, radius, centre, total, *halves(own)))
        at += 1
    return order, Balls(*map(np.array, zip(*rows, strict=True)))


def trees(vectors: DataFrame, dims: int) -> DataFrame:
    """vectors (id, v) as blocks with a tree each, made within each task."""

    def block(ids: list, points: list[np.ndarray]) -> pa.RecordBatch:
        joined = np.concatenate(points)
        if len(joined) and np.abs(joined).max() > LARGEST:
            raise ValueError(f"a component is larger than {LARGEST}")
        order, balls = grown(joined)
        return pa.RecordBatch.from_arrays([pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([joined[order].astype("<i4").tobytes()]), pa.array([balls.pack()])], names=["ids", "points", "ball"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids += part.column(0).to_pylist()
                points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                n += part.num_rows
                if n >= BLOCK:
                    yield block(ids, points)
                    ids, points, n = [], [], 0
        if n:
            yield block(ids, points)

    return vectors.select("id", "v").mapInArrow(run, TREES)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, the smaller number of two, in integers."""
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], 1).argmin(1)


def assigned(balls: Balls, points: np.ndarray, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(cluster, balls that lie wholly in it, places of the vectors that leaves gave it): every vector once."""
    k, real = len(centroids), centroids.astype(np.float64)
    level, live = np.zeros(1, np.int64), np.ones((1, k), bool)
    whole: list[list[np.ndarray]] = [[] for _ in range(k)]
    leaves = [np.zeros(0, np.int64)]
    while len(level):
        d = np.stack([np.sqrt(((balls.centre[level] - c) ** 2).sum(1)) for c in real], 1)
        r, slack = balls.radius[level][:, None], d * SHARE + LEAST
        far = np.where(live, d + r + slack, np.inf).min(1)
        live = live & (d - r - slack <= far[:, None])  # the others are farther from every vector of the ball than one that is live
        alone = live.sum(1) == 1
        only = np.where(alone, live.argmax(1), -1)
        for j in range(k):
            whole[j].append(level[only == j])
        leaf = ~alone & (balls.left[level] == 0)
        leaves += [np.arange(balls.first[n], balls.last[n]) for n in level[leaf]]
        down = ~alone & ~leaf
        level, live = np.concatenate([balls.left[level[down]], balls.left[level[down]] + 1]), np.concatenate([live[down]] * 2)
    places = np.concatenate(leaves)
    best = nearest(points[places], centroids)
    for j in range(k):
        yield j, np.concatenate(whole[j]), places[best == j]


def _read(row: dict, dims: int) -> tuple[Balls, np.ndarray]:
    return Balls.unpack(row["ball"]), np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(-1, dims)


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int], int]]:
    """Count, sum and inertia of each cluster; a row for each cluster comes back."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, inertia = [0] * k, [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            for row in batch.to_pylist():
                balls, points = _read(row, dims)
                for j, whole, places in assigned(balls, points, centroids):
                    own, c = points[places], [int(x) for x in centroids[j]]
                    n = int((balls.last[whole] - balls.first[whole]).sum()) + len(own)
                    s = [int(x) for x in balls.total[whole].sum(0) + own.sum(0)]
                    high, low = halves(own)
                    count[j] += n
                    total[j] = [x + y for x, y in zip(total[j], s, strict=True)]
                    inertia[j] += ((int(balls.high[whole].sum()) + high) << 32) + int(balls.low[whole].sum()) + low - 2 * sum(x * y for x, y in zip(s, c, strict=True)) + n * sum(x * x for x in c)
        found = [j for j in range(k) if count[j]]
        yield pa.RecordBatch.from_pylist([{"cluster": j, "n": count[j], "total": [str(x) for x in total[j]], "inertia": str(inertia[j])} for j in found], pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.string())), ("inertia", pa.string())]))

    parts = blocks.select("ball", "points").mapInArrow(run, "cluster int, n long, total array<string>, inertia string")
    whole = "decimal(38,0)"  # sums of longs
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i].cast(whole)) for i in range(dims)]).alias("total"), F.sum(F.col("inertia").cast(whole)).alias("inertia"))
    return {r["cluster"]: (r["n"], [int(x) for x in r["total"]], int(r["inertia"])) for r in merged.collect()}


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least sha256 of `seed:id`, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", name.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, cluster int, distance long (squared), cluster_inertia and inertia long, centroid array of long: a row for each vector that is kept."""
    spark = vectors.sparkSession
    shape = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(f"`{vec_col}`", dims, scale).alias("v")).where("v is not null")
    centroids = starts(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], T.StructType([*shape, T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.LongType()))]))
    if np.abs(centroids).max() > LARGEST:
        raise ValueError(f"a component is larger than {LARGEST}")
    blocks = materialise(trees(kept, dims))
    for _ in range(rounds):
        for j, (n, total, _) in sums(blocks, centroids).items():
            centroids[j] = [x // n for x in total]
    final = sums(blocks, centroids)
    inertia = sum(x[2] for x in final.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                balls, points = _read(row, dims)
                best = np.empty(len(points), np.int32)
                for j, whole, places in assigned(balls, points, centroids):
                    best[places] = j
                    for a, b in zip(balls.first[whole], balls.last[whole], strict=True):
                        best[a:b] = j
                away = ((points - centroids[best]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(best, pa.int32()), pa.array(away, pa.int64())], names=shape.names)

    rows = [(j, final[j][2], inertia, [int(x) for x in centroids[j]]) for j in sorted(final)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return blocks.mapInArrow(run, shape).join(F.broadcast(about), "cluster").select(f"`{id_col}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def centroid_name(col: str = "centroid") -> Column:
    """The sha256 of a centroid's components in decimal, joined by commas."""
    return F.sha2(F.array_join(F.col(col).cast("array<string>"), ","), 256)



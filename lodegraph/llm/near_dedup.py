"""MinHash near-dedup: links by Jaccard similarity of shingle sets, and their components.

1. A document becomes its set of `size`-word shingles, 64-bit hashes; the set's own
   hash names the node, so equal sets are one node however many copies there are.
   bands * rows universal hash functions give minima; `rows` of them make a band.
2. Nodes that share a band are candidates. In each band's bucket every node is paired
   with the least one only, so candidates grow with the nodes, not with pairs.
3. A pair is dropped if too few bands agree for its similarity; what remains is
   confirmed on full sets. Components: `components`.
   A bucket's nodes that the least one didn't link get RETRIES more partners: others of the bucket's largest
   component, drawn by a hash of bucket and node, so that a node meets many of a large group's
   members and not the least one again.
4. The rest is exact. In each bucket most nodes are of one component by now; X are
   the nodes of some bucket that aren't, Y all nodes of such buckets. Two sets as similar
   as asked share one of their rarest shingles (prefix filtering), so X and Y are
   joined on those, rarest by the count in Y. What a set shares with any other is at
   most its shingles that are not its own alone, and at most what follows the shared
   one; pairs that can't reach the similarity by these bounds are never made. So a large
   group of near copies yields no pairs of its stragglers: their edits are their own.

The chance that a pair at exactly the threshold of 0.8 shares no band is
(1 - 0.8**5)**50 = 2.4e-9, that it shares less than two 6.1e-8, and both fall
steeply above it.

Defined cases: a document without words or text has an empty set and no links; one
with fewer words than a shingle has its whole sequence as one; a null id is in no
component (component_id null, kept true); rows of one id and different sets are
all linked to one another, as they are one document; columns with the names of
outputs are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm import rolling
from lodegraph.llm.common import discard, materialise
from lodegraph.llm.components import components

SIZE, BANDS, ROWS, PERCENT = 2, 50, 5, 80
#: Bands that must agree before full sets are compared.
AGREE = 2
#: Earlier shingles of a prefix by which a pair is known to have met before.
EARLIER = 32
#: Rounds in which what isn't linked yet is compared with another member of its buckets' components. They only spare work of the exact step.
RETRIES = 1
#: Nodes up to this number are sent to all executors (8 bytes each); more are joined.
SENT_NODES = 1_000_000
FEATURES = "doc_id long, n long, node long, bands array<long>"


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text one after another, sorted, and where each text's begin."""
    words = rolling.Words(texts, lower=True)
    sums = rolling.prefix(words.hashes())
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    begin = words.first[:-1][doc] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # a sequence shorter than a shingle is told apart from shingles by its length, which is mixed in
    length = np.minimum(size, counts)[doc]
    s = rolling.mix(rolling.span(sums, begin, begin + length) + length.astype(np.uint64))
    order = np.lexsort([s, doc])
    s, doc = s[order], doc[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.empty(0, bool)
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_240_607))
    return rng.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def _features(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _functions(bands * rows)
        for batch in batches:
            for first, end, texts in rolling.chunks(batch.column(1).to_pylist()):
                s, at = _sets(texts, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                starts = at[:-1][some]
                node, signature = np.zeros(len(texts), np.uint64), np.zeros((len(some), bands), np.uint64)
                if len(some):
                    node[some] = rolling.mix(np.add.reduceat(s, starts) ^ np.multiply(n[some].astype(np.uint64), np.uint64(rolling.MIX[0])))
                    x = (s >> np.uint64(32)).astype(np.uint32)
                    for b in range(bands):
                        key = np.full(len(some), b + 1, dtype=np.uint64)
                        for r in range(b * rows, b * rows + rows):
                            least = np.minimum.reduceat(x * factors[r] + offsets[r], starts)
                            key = rolling.mix(key * np.uint64(rolling.WORD_BASES[0]) + least.astype(np.uint64))
                        signature[:, b] = key
                flat = pa.array(signature.reshape(-1).view(np.int64))
                where = np.zeros(len(texts) + 1, np.int32)
                where[1:] = np.cumsum(np.where(n > 0, bands, 0))
                columns = [batch.column(0).slice(first, end - first), pa.array(n.astype(np.int64)), pa.array(node.view(np.int64), mask=n == 0), pa.ListArray.from_arrays(pa.array(where), flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "node", "bands"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(batch.column(k).to_numpy()) for k in (0, 1))
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q]))) if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["u", "v"])

    return run


def _sets_of(asked: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, each: bool) -> DataFrame:
    """(node, members) of the nodes in asked (node), or with each (node, shingle, n), a row for each shingle."""
    holders = materialise(nodes.join(asked, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    wanted = holders.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if holders.count() <= SENT_NODES else wanted.hint("shuffle_hash")
    # an id with several texts gives the sets of all of them; the right one has the node's name
    kind = "node long, shingle long, n long" if each else "node long, members binary"
    return texts.join(wanted, "doc_id", "left_semi").mapInArrow(_named_sets(size, each), kind).join(holders.select("node"), "node", "left_semi")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those of pairs (u, v) whose full sets are similar enough."""
    pairs = materialise(pairs)
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = materialise(_sets_of(asked, nodes, docs, size, id_col, text_col, False))
    both = pairs.join(sets.withColumnsRenamed({"node": "u", "members": "a"}), "u").join(sets.withColumnsRenamed({"node": "v", "members": "b"}), "v")
    out = materialise(both.select("u", "v", "a", "b").mapInArrow(_confirm(percent), "u long, v long"))
    discard(sets)
    return out


def _mixed(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """(band, node, label, usual) of the buckets with several components: each node's and the largest one of the bucket."""
    placed = buckets.join(label.withColumnsRenamed({"u": "node", "v": "label"}), "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    counted = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = counted.groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("usual"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("band", "usual")
    return placed.join(mixed, "band")


def _retries(buckets: DataFrame, label: DataFrame, salt: int) -> DataFrame:
    """Pairs (u, v) of each node outside of its bucket's largest component with a member of that, drawn by a hash."""
    placed = materialise(_mixed(buckets, label))
    drawn = placed.where(F.col("label") == F.col("usual")).groupBy("band").agg(F.min_by("node", F.xxhash64("node", "band", F.lit(salt))).alias("partner"))
    met = placed.where(F.col("label") != F.col("usual")).join(drawn, "band")
    return met.select(F.least("node", "partner").alias("u"), F.greatest("node", "partner").alias("v")).distinct()


def _stragglers(buckets: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (u, v) of nodes of different components that bounds don't rule out, where buckets hold several components."""
    there = materialise(_mixed(buckets, label).groupBy("node", "label").agg(F.max(F.col("label") != F.col("usual")).alias("x")))
    own = _sets_of(there.select("node"), nodes, docs, size, id_col, text_col, True).distinct()
    shingles = materialise(own)
    common = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = shingles.join(common, "shingle")
    # a set's own shingles come first; of the others those in fewest sets
    by_node = Window.partitionBy("node")
    order = by_node.orderBy("df", "shingle")
    earlier = F.collect_list("shingle").over(order.rowsBetween(-EARLIER, -1))
    ranked = shared.withColumns({"alone": F.col("n") - F.count(F.lit(1)).over(by_node), "k": F.row_number().over(order), "earlier": earlier})
    ranked = ranked.withColumn("p", F.col("alone") + F.col("k"))
    able = (100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")) & (100 * (F.col("n") - F.col("p") + 1) >= percent * F.col("n"))
    prefixes = materialise(ranked.where(able).join(there, "node").select("node", "label", "x", "shingle", "n", "p", "alone", "earlier"))
    a = prefixes.where("x").select("shingle", *[F.col(c).alias(f"{c}1") for c in ("node", "label", "n", "p", "alone", "earlier")])
    b = prefixes.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "p", "alone", "earlier")])
    whole = percent * (F.col("n1") + F.col("n2"))
    reach = lambda x, y: (100 + percent) * F.least(x, y) >= whole
    possible = (F.col("label1") != F.col("label2")) & reach(F.col("n1") - F.col("p1") + 1, F.col("n2") - F.col("p2") + 1) & reach(F.col("n1") - F.col("alone1"), F.col("n2") - F.col("alone2"))
    possible = possible & ~F.arrays_overlap("earlier1", "earlier2")  # the shingle that both have first makes the pair
    return a.join(b, (a["shingle"] == b["shingle"]) & possible).select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v")).distinct()


def _named_sets(size: int, each: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in rolling.chunks(batch.column(1).to_pylist()):
                s, at = _sets(texts, size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                node = rolling.mix(np.add.reduceat(s, at[:-1][some]) ^ np.multiply(n[some].astype(np.uint64), np.uint64(rolling.MIX[0])))
                if each:
                    columns = [pa.array(np.repeat(node, n[some]).view(np.int64)), pa.array(s.view(np.int64)), pa.array(np.repeat(n[some], n[some]))]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "shingle", "n"])
                    continue
                members = pa.array([s[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), members], names=["node", "members"])

    return run


def near_dedup(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each of docs."""
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    features = materialise(given.mapInArrow(_features(size, bands, rows), FEATURES))
    named = features.where("node is not null and doc_id is not null")
    # equal sets are one node; an id with several sets links its nodes
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    twice = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).where("u <> w").select("doc_id", "u")
    same_id = named.join(twice, "doc_id").select("u", F.col("node").alias("v"))
    banded = features.where("node is not null and doc_id is not null").select("node", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").select("band", "hub")
    buckets = materialise(banded.join(crowded, "band").select("band", "node", "hub").distinct())
    tried = buckets.where("node <> hub").groupBy(F.col("node").alias("u"), F.col("hub").alias("v")).agg(F.count(F.lit(1)).alias("agree"))
    links = _confirmed(_agreeing(tried.select("u", "v"), buckets), named, docs, size, percent, id_col, text_col)
    edges = materialise(links.union(same_id))
    label = components(edges)
    for salt in range(RETRIES):
        again = _confirmed(_agreeing(_retries(buckets, label, salt), buckets), named, docs, size, percent, id_col, text_col)
        if again.isEmpty():
            break
        edges = materialise(edges.union(again))
        label = components(edges)
    rest = _stragglers(buckets, label, named, docs, size, percent, id_col, text_col)
    more = _confirmed(rest, named, docs, size, percent, id_col, text_col)
    label = components(edges.union(more))

    known = nodes.join(label.withColumnsRenamed({"u": "node", "v": "label"}), "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = known.join(least, "label").select("node", "component_id")
    return features.join(found, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def _agreeing(pairs: DataFrame, buckets: DataFrame) -> DataFrame:
    """The pairs of which at least AGREE bands agree."""
    held = buckets.groupBy("node").agg(F.collect_set("band").alias("bands"))
    both = pairs.join(held.withColumnsRenamed({"node": "u", "bands": "a"}), "u").join(held.withColumnsRenamed({"node": "v", "bands": "b"}), "v")
    return both.where(F.size(F.array_intersect("a", "b")) >= AGREE).select("u", "v")

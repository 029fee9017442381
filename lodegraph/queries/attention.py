"""Queries of message passing and gated attention, with parameters from a formula that SQL can follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import attention as at
from lodegraph.registry import query
from lodegraph.sources.tables import table

DIMS, WIDTH, HEADS, RELATIONS = 64, 8, 2, 3
#: (a i + b j + c r) mod m, less d, over e.
FORMULAS = {"w1": (7, 13, 5, 17, 8, 16), "w2": (3, 11, 7, 13, 6, 16), "base": (5, 3, 0, 11, 5, 32)}
SIDES = {"s1": (5, 1, 7, 3, 4), "t1": (3, 2, 7, 3, 4), "s2": (4, 3, 9, 4, 4), "t2": (2, 1, 5, 2, 4), "b1": (3, 0, 5, 2, 20), "b2": (2, 1, 7, 3, 20), "b0": (4, 2, 7, 3, 20)}


def _weights(name: str, ins: int, relations: int = RELATIONS) -> np.ndarray:
    a, b, c, m, d, e = FORMULAS[name]
    r, i, j = np.meshgrid(np.arange(relations), np.arange(ins), np.arange(WIDTH), indexing="ij")
    return ((a * i + b * j + c * r) % m - d) / e


def _side(name: str) -> np.ndarray:
    a, b, m, d, e = SIDES[name]
    return ((a * np.arange(WIDTH) + b) % m - d) / e


def _layer(k: int, ins: int) -> at.Layer:
    half = WIDTH // HEADS
    return at.Layer(_weights(f"w{k}", ins), _side(f"s{k}").reshape(HEADS, half), _side(f"t{k}").reshape(HEADS, half), _side(f"b{k}"))


def _rounded(vector: str, places: int = 5) -> Column:
    """As SQL rounds: a number just below zero keeps its sign, -0.0."""
    near = lambda x: F.round(x, places)
    return F.transform(vector, lambda x: F.when((x < 0) & (near(x) == 0), F.lit(-0.0)).otherwise(near(x)))


def _formula_sql(name: str, i: str, j: str, r: str) -> str:
    a, b, c, m, d, e = FORMULAS[name]
    return f"((({a} * {i} + {b} * {j} + {c} * {r}) % {m}) - {d}) / {e}.0"


def _side_sql(name: str, j: str) -> str:
    a, b, m, d, e = SIDES[name]
    return f"((({a} * {j} + {b}) % {m}) - {d}) / {e}.0"


def _layer_sql(k: int, state: str) -> str:
    """h{k} (node, i, x) from state by the layer's parameters."""
    half = WIDTH // HEADS
    times = f"SELECT u.node, u.rel, j, sum(x * {_formula_sql(f'w{k}', 'i', 'j', 'u.rel')}) AS t"
    return f"""src{k} AS MATERIALIZED ({times} FROM (SELECT DISTINCT src AS node, rel FROM e) u JOIN {state} h ON h.node = u.node, j GROUP BY ALL),
dst{k} AS MATERIALIZED ({times} FROM (SELECT DISTINCT dst AS node, rel FROM e) u JOIN {state} h ON h.node = u.node, j GROUP BY ALL),
raw{k} AS (SELECT k, e.dst, j // {half} AS head, sum(s.t * {_side_sql(f's{k}', 'j')} + d.t * {_side_sql(f't{k}', 'j')}) AS z
  FROM e JOIN src{k} s ON s.node = e.src AND s.rel = e.rel JOIN dst{k} d USING (j) WHERE d.node = e.dst AND d.rel = e.rel GROUP BY ALL),
soft{k} AS (SELECT k, dst, head, exp(z - max(z) OVER (PARTITION BY dst, head)) AS p FROM (SELECT k, dst, head, CASE WHEN z > 0 THEN z ELSE {at.SLOPE} * z END AS z FROM raw{k})),
sum{k} AS (SELECT e.dst, j, sum(p * t) / sum(p) AS x FROM e JOIN soft{k} f USING (k) JOIN src{k} s ON s.node = e.src AND s.rel = e.rel AND s.j // {half} = f.head GROUP BY ALL),
h{k} AS MATERIALIZED (SELECT node, j AS i, greatest(coalesce(x, 0) + {_side_sql(f'b{k}', 'j')}, 0) AS x FROM (SELECT DISTINCT node FROM h0) CROSS JOIN j LEFT JOIN sum{k} USING (j) WHERE sum{k}.dst = node
  UNION ALL SELECT node, j, greatest({_side_sql(f'b{k}', 'j')}, 0) FROM (SELECT DISTINCT node FROM h0 WHERE node NOT IN (SELECT dst FROM e)), j)"""


#: A vector leads to the next one; all vectors of a label lead to its first, a hub, and it leads to them.
GRAPH_SQL = """hub AS (SELECT label, min(vec_id) AS hub FROM embeddings GROUP BY 1),
pair AS (SELECT vec_id AS src, 0 AS rel, vec_id + 1 AS dst FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)
  UNION ALL SELECT vec_id, 1, hub FROM embeddings JOIN hub USING (label) WHERE vec_id <> hub UNION ALL SELECT hub, 2, vec_id FROM embeddings JOIN hub USING (label) WHERE vec_id <> hub),
e AS MATERIALIZED (SELECT row_number() OVER () AS k, src, rel, dst FROM pair)"""


def graph_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    nodes = v.select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").cast("array<double>").alias("h"))
    ids = v.select((F.col("vec_id") - 1).alias("vec_id"))
    following = v.join(ids, "vec_id", "left_semi").select(F.col("vec_id").alias("src"), F.lit(0).alias("rel"), (F.col("vec_id") + 1).alias("dst"))
    member = v.join(v.groupBy("label").agg(F.min("vec_id").alias("hub")), "label").where("vec_id <> hub")
    pairs = following.unionByName(member.select(F.col("vec_id").alias("src"), F.lit(1).alias("rel"), F.col("hub").alias("dst"))).unionByName(member.select(F.col("hub").alias("src"), F.lit(2).alias("rel"), F.col("vec_id").alias("dst")))
    return nodes, pairs.select(F.col("src").cast("string").alias("src"), "rel", F.col("dst").cast("string").alias("dst"))


@query(f"""WITH {GRAPH_SQL},
j AS (SELECT unnest(range(0, {WIDTH})) AS j),
h0 AS MATERIALIZED (SELECT vec_id AS node, unnest(range(0, {DIMS})) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
{_layer_sql(1, "h0")},
{_layer_sql(2, "h1")},
base AS (SELECT node, j AS i, sum(x * {_formula_sql("base", "i", "j", "0")}) + any_value({_side_sql("b0", "j")}) AS x FROM h0, j GROUP BY node, j)
SELECT node::VARCHAR AS node_id, list(round(h2.x + base.x, 5) ORDER BY i) AS h FROM h2 JOIN base USING (node, i) GROUP BY 1""")
def graph_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of relational attention over all vectors and the graph of their labels, plus a linear map of the vectors."""
    nodes, edges = graph_of(spark, sf_dir)
    out = at.encoded(nodes, edges, [_layer(1, DIMS), _layer(2, WIDTH)], _weights("base", DIMS, 1)[0], _side("b0"))
    return out.select("node_id", _rounded("h").alias("h"))


MODEL, SLOTS, CHUNK = 4, 2, 2
#: A position's state: its length, its number of words, its place, and whether the user speaks. A slot: two numbers of a turn.
STATE = ["length(coalesce(text, '')) / 200.0", "len(string_split(coalesce(text, ''), ' ')) / 40.0", "turn / 4.0", "CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END"]
GATE = at.Gate(
    query=np.array([[(3 * i + 5 * j) % 7 - 3 for j in range(MODEL)] for i in range(MODEL)]) / 4.0,
    key=np.array([[(2 * i + 3 * j) % 5 - 2 for j in range(MODEL)] for i in range(SLOTS)]) / 2.0,
    value=np.array([[(4 * i + j) % 5 - 2 for j in range(MODEL)] for i in range(SLOTS)]) / 2.0,
    out=np.array([[(i + 2 * j) % 5 - 2 for j in range(MODEL)] for i in range(MODEL)]) / 4.0,
    gain=np.ones(MODEL),
    shift=np.zeros(MODEL),
    heads=2,
    alpha=0.3,
)


def _gate_sql(m: np.ndarray, vector: str) -> str:
    """vector times m, as a list."""
    return "[" + ", ".join(" + ".join(f"{vector}[{i + 1}] * ({x})" for i, x in enumerate(column)) for column in m.T) + "]"


@query(f"""WITH s AS (SELECT conv_id AS seq, turn AS pos, [{", ".join(STATE)}] AS h FROM conversations),
n AS (SELECT *, list_transform(h, lambda x: x - list_avg(h)) AS a FROM s),
m AS (SELECT seq, pos, h, list_transform(a, lambda x: x / sqrt(list_avg(list_transform(a, lambda y: y * y)) + 0.00001)) AS u FROM n),
q AS (SELECT seq, pos, h, {_gate_sql(GATE.query, "u")} AS q, CASE WHEN pos >= {CHUNK - 1} THEN (pos - {CHUNK - 1}) // {CHUNK} END AS chunk FROM m),
b AS (SELECT seq, pos // {CHUNK} AS chunk, {_gate_sql(GATE.key, "h")} AS k, {_gate_sql(GATE.value, "h")} AS v FROM s),
z AS (SELECT q.seq, q.pos, g, v, exp((q.q[2 * g + 1] * k[2 * g + 1] + q.q[2 * g + 2] * k[2 * g + 2]) / sqrt(2.0)) AS p FROM q JOIN b USING (seq, chunk), (VALUES (0), (1)) t(g)),
w AS (SELECT seq, pos, g, [sum(p * v[2 * g + 1]) / sum(p), sum(p * v[2 * g + 2]) / sum(p)] AS o FROM z GROUP BY 1, 2, 3),
o AS (SELECT seq, pos, flatten(list(o ORDER BY g)) AS o FROM w GROUP BY 1, 2),
r AS (SELECT seq, pos, list_transform({_gate_sql(GATE.out, "o")}, lambda x: x * tanh({GATE.alpha})) AS c FROM o)
SELECT s.seq AS conv_id, s.pos AS turn, list_transform(list_zip(s.h, coalesce(c, [0.0, 0.0, 0.0, 0.0])), lambda p: round(p[1] + p[2], 5)) AS h,
  round(coalesce(sqrt(list_sum(list_transform(c, lambda x: x * x))) / sqrt(list_sum(list_transform(s.h, lambda x: x * x))), 0.0), 5) AS contribution
FROM s LEFT JOIN r USING (seq, pos)""")
def gated_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation, gated by attention to the slots of the chunk that was complete before them."""
    t = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    parts = [F.length(text) / 200.0, F.size(F.split(text, " ")) / 40.0, F.col("turn") / 4.0, F.when(F.col("role") == "user", 1.0).otherwise(0.0)]
    states = t.select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.array(*[p.cast("double") for p in parts]).alias("h"))
    bank = states.select("seq", F.floor(F.col("pos") / CHUNK).cast("long").alias("chunk"), F.col("pos").alias("slot"), F.slice("h", 1, SLOTS).alias("e"))
    chunk = F.when(F.col("pos") >= CHUNK - 1, F.floor((F.col("pos") - (CHUNK - 1)) / CHUNK).cast("long"))
    out = at.gated_attention(states, bank, chunk, GATE)
    return out.select(F.col("seq").alias("conv_id"), F.col("pos").alias("turn"), _rounded("h").alias("h"), F.round("contribution", 5).alias("contribution"))

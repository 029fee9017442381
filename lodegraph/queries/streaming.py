"""Queries of chunk-scheduled streaming: geometry and the batch twin, the stream itself, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.operators.durable import kept, new_folder
from lodegraph.registry import query
from lodegraph.sources.tables import table
from lodegraph.streaming import chunks as c

M = 16


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.filter(F.split("text", " "), lambda x: x != "")).alias("n"))


LEN = "l AS (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM conversations)"


@query(f"WITH {LEN}, s AS (SELECT conv_id, turn, n, unnest(range(0, n, {M})) AS start FROM l) SELECT conv_id, turn, start, least(start + {M}, n) AS \"end\" FROM s")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every turn."""
    s = lengths(spark, sf_dir).select("conv_id", "turn", F.explode(c.spans(F.col("n"), M)).alias("s"))
    return s.select("conv_id", "turn", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(f"WITH {LEN}, p AS (SELECT conv_id, turn, unnest(range(0, n)) AS p FROM l) SELECT conv_id, turn, p, CASE WHEN p >= {M - 1} THEN (p - {M - 1}) // {M} END AS chunk FROM p")
def active_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active chunk at every position."""
    p = lengths(spark, sf_dir).where("n > 0").select("conv_id", "turn", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    return p.select("conv_id", "turn", F.col("p").cast("long").alias("p"), c.active_chunk(F.col("p"), M).alias("chunk"))


@query(f"""WITH {LEN}, h AS (SELECT conv_id, turn, 0::BIGINT AS start, least({M - 1}, n)::BIGINT AS "end", NULL::BIGINT AS query_chunk FROM l WHERE n > 0), u AS (SELECT conv_id, turn, n, unnest(range(0, n // {M})) AS u FROM l)
FROM h UNION ALL SELECT conv_id, turn, u * {M} + {M - 1}, least(u * {M} + {2 * M - 1}, n), u FROM u""")
def window_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches between retrievals."""
    s = lengths(spark, sf_dir).select("conv_id", "turn", F.explode(c.window_plan(F.col("n"), M)).alias("s"))
    return s.select("conv_id", "turn", *[F.col(f"s.{x}").cast("long").alias(x) for x in ("start", "end", "query_chunk")])


@query(f"""WITH {LEN}, u AS (SELECT conv_id, turn, n, unnest(range(0, n // {M})) AS u FROM l), w AS (SELECT conv_id, turn, u * {M} + {M - 1} AS s, least(u * {M} + {2 * M - 1}, n) AS e, u FROM u UNION ALL SELECT conv_id, turn, 0, least({M - 1}, n), NULL FROM l WHERE n > 0)
SELECT conv_id, turn, greatest(s, 20) - 20 AS start, least(e, 60) - 20 AS "end", u AS query_chunk FROM w WHERE greatest(s, 20) < least(e, 60)""")
def clipped_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the window [20, 60)."""
    s = lengths(spark, sf_dir).select("conv_id", "turn", F.explode(c.clipped(c.window_plan(F.col("n"), M), F.lit(20), F.lit(60))).alias("s"))
    return s.select("conv_id", "turn", *[F.col(f"s.{x}").cast("long").alias(x) for x in ("start", "end", "query_chunk")])


@query(f"WITH {LEN}, u AS (SELECT conv_id, turn, n // {M} AS boundaries, unnest(range(0, n // {M})) AS u FROM l) SELECT conv_id, turn, u AS chunk, u * {M} AS start, u * {M} + 5 AS \"end\", boundaries, boundaries >= 2 AS expressible FROM u")
def query_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speculative prefix of each chunk, and whether a run has boundaries enough."""
    n = lengths(spark, sf_dir).withColumn("boundaries", c.boundaries_expected(F.col("n"), M))
    u = n.where("boundaries > 0").select("conv_id", "turn", "boundaries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("boundaries") - 1)).alias("chunk"))
    a, b = c.query_span(F.col("chunk"), M, 5)
    return u.select("conv_id", "turn", "chunk", a.alias("start"), b.alias("end"), "boundaries", (F.col("boundaries") >= 2).alias("expressible"))


CHUNKS_SQL = f"""WITH w AS (SELECT conv_id AS key, list_filter(string_split(string_agg(text, ' ' ORDER BY turn), ' '), lambda x: x <> '') AS w FROM conversations GROUP BY 1),
u AS (SELECT key, w, unnest(range(0, len(w) // {M})) AS u FROM w) SELECT key, u AS chunk, array_to_string(w[u * {M} + 1:u * {M} + {M}], ' ') AS text FROM u"""


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return said.select("key", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "token"))


@query(CHUNKS_SQL)
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the batch twin: complete chunks of each conversation."""
    return c.chunk_batches(conversation_tokens(spark, sf_dir), M)


#: The stream of events: chunks of four, a key closes after two days, rows may be an hour late.
SESSION = (4, "2 days", "1 hour")
SESSIONS_SQL = """WITH a AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token, ts FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 DAY THEN 1 ELSE 0 END AS gap FROM a WHERE token <> 'error' WINDOW w AS (PARTITION BY key ORDER BY ts, pos)),
r AS (SELECT *, sum(gap) OVER (PARTITION BY key ORDER BY ts, pos) AS part FROM g),
s AS (SELECT key, part, max(pos) AS top, max(ts) AS last FROM r GROUP BY 1, 2),
k AS (SELECT key, part, coalesce(max(top) OVER (PARTITION BY key ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 4 + 1, 0) AS first,
  lead(part) OVER (PARTITION BY key ORDER BY part) IS NOT NULL OR last + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM r) AS closed FROM s),
p AS (SELECT r.*, pos // 4 AS chunk, first, closed FROM r JOIN k USING (key, part)),
c AS (SELECT key, part, chunk, first, closed, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS text FROM p WHERE chunk >= first GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT *, sum(CASE WHEN n = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY key, part ORDER BY chunk) AS whole FROM c)
SELECT key, chunk, text, CASE WHEN n = 4 THEN 'complete' ELSE 'incomplete' END AS status, n FROM f WHERE closed OR whole = chunk - first + 1
UNION ALL SELECT key, NULL, NULL, 'late', count(*) FROM p WHERE closed AND chunk < first GROUP BY key, part"""


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by their place; errors are lost on the way, which leaves holes."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    numbered = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), place.cast("long").alias("pos"), F.col("event_type").alias("token"), "ts")
    return numbered.where("token <> 'error'").withColumn("ts", F.col("ts").cast("timestamp"))


@query(SESSIONS_SQL)
def chunk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the batch twin: chunks of each user's events with holes, closed when no event comes for two days."""
    return c.chunk_sessions(event_tokens(spark, sf_dir), *SESSION)


@query(SESSIONS_SQL)
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the same chunks from a stream of the events, with keyed state and event-time timers."""
    path, parts, files = new_folder(spark, "tokens"), 4, 4
    tokens = kept(event_tokens(spark, sf_dir))
    ends = tokens.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b"))
    share = (F.unix_micros("ts") - F.col("a")) * parts / (F.col("b") - F.col("a") + 1)
    dealt = tokens.join(F.broadcast(ends)).select(*tokens.columns, F.floor(share).alias("part"))  # one row
    for k in range(parts):  # a stretch of time after the other, as they would come; each trigger reads one
        dealt.where(F.col("part") == k).drop("part").repartition(files).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key long, pos long, token string, ts timestamp").option("maxFilesPerTrigger", files).parquet(path)
    return c.drained(c.chunk_stream(stream, *SESSION), "chunks")


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY text) AS asked FROM conversations")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are retrieved once and joined back."""
    t = table(spark, sf_dir, "conversations")
    counts = t.groupBy("text").agg(F.count(F.lit(1)).alias("asked"))
    return c.once_per_text(t, lambda texts: texts.join(counts, "text")).select("conv_id", "turn", "asked")


@query("""SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, not parity: tumbling event-time windows."""
    w = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, not parity: sessions with a gap of six hours."""
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("begin"), "n")

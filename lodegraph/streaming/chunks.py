"""Chunk-scheduled retrieval over token streams: geometry as expressions, the stream as keyed state.

A sequence of n tokens is cut into chunks of m. The window of chunk u begins at
u*m + m - 1, when the chunk is complete, and lasts m tokens; before the first, nothing is active.
The stream keeps, for each key, the tokens of chunks that aren't complete and the number of
the next chunk; tokens carry their position and may arrive in any order. A key with a hole is closed by
a timer. The batch twin cuts each key's tokens where the timer would and must give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodegraph.operators.durable import new_folder


def spans(n: Column, m: int) -> Column:
    """[start, end) of every chunk."""
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(m))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + m, n).alias("end")))


def active_chunk(position: Column, m: int) -> Column:
    """The chunk whose result holds at a position; null before the first is complete."""
    return F.when(position >= m - 1, F.floor((position - (m - 1)) / m).cast("long"))


def window_plan(n: Column, m: int) -> Column:
    """(start, end, query_chunk) of every stretch between retrievals, the first without a query."""
    head = F.when(n > 0, F.array(F.struct(F.lit(0).cast("int").alias("start"), F.least(F.lit(m - 1), n).cast("int").alias("end"), F.lit(None).cast("int").alias("query_chunk")))).otherwise(F.array().cast("array<struct<start:int,end:int,query_chunk:int>>"))
    head = F.filter(head, lambda x: x["end"] > x["start"])
    count = F.when(n >= m, F.floor((n - m) / m).cast("int") + 1).otherwise(0)
    rest = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda u: F.struct((u * m + m - 1).cast("int").alias("start"), F.least(u * m + 2 * m - 1, n).cast("int").alias("end"), u.cast("int").alias("query_chunk")))).otherwise(F.array().cast("array<struct<start:int,end:int,query_chunk:int>>"))
    return F.concat(head, rest)


def clipped(plan: Column, begin: Column, end: Column) -> Column:
    """A plan within [begin, end), from 0; query chunks stay as they are."""
    cut = F.transform(plan, lambda x: F.struct((F.greatest(x["start"], begin) - begin).alias("start"), (F.least(x["end"], end) - begin).alias("end"), x["query_chunk"].alias("query_chunk")))
    return F.filter(cut, lambda x: x["start"] < x["end"])


def query_span(chunk: Column, m: int, prefix: int) -> tuple[Column, Column]:
    """The part of a chunk that queries: its first `prefix` tokens."""
    if not 1 <= prefix <= m:
        raise ValueError("1 <= prefix <= m")
    return chunk * m, chunk * m + prefix


def boundaries_expected(n: Column, m: int) -> Column:
    """How many chunks are complete: retrievals that a run makes; two at least tell a moving retriever from a static one."""
    return F.floor(n / m).cast("long")


def chunk_batches(tokens: DataFrame, m: int) -> DataFrame:
    """(key, chunk, text) of complete chunks of tokens (key, pos, token). The batch twin of `chunk_stream`."""
    grouped = tokens.dropDuplicates(["key", "pos"]).groupBy("key", F.floor(F.col("pos") / m).cast("long").alias("chunk"))
    whole = grouped.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t")).where(F.col("n") == m)
    return whole.select("key", "chunk", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("text"))


#: chunk and text are null in a row that counts late tokens; n is the number of tokens that the row stands for.
CHUNKS = "key long, chunk long, text string, status string, n long"
COMPLETE, INCOMPLETE, LATE = "complete", "incomplete", "late"
NEVER = -(2**63)


class ChunkProcessor(StatefulProcessor):
    """The open chunks of one key: its next chunk's tokens and, apart, those of later ones; an event-time timer closes what no token has come to for `patience` microseconds.

    A closed stretch gives its chunks as they are, whole or not, and the key goes on behind them; tokens of earlier chunks are late and
    counted. `forget` microseconds after that a second timer removes what is left of the key.
    Each call on the state is an exchange with the JVM, so their number doesn't depend on that of the tokens: later tokens are appended as one entry, and read only when the next
    chunk is whole or closed. Entries stay until more of their tokens are through than wait.
    """

    def __init__(self, m: int, patience: int, forget: int):
        self.m, self.patience, self.forget = m, patience, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: The next chunk, late tokens so far, when the last token came (NEVER: the stretch is closed), the timer (NEVER: none), how many tokens `later` has; tokens of the next chunk.
        self.head = handle.getValueState("head", "nxt long, late long, last long, timer long, behind long, pos array<long>, token array<string>")
        self.later = handle.getListState("later", "pos array<long>, token array<string>")

    def _load(self) -> None:
        self.nxt, self.late, self.last, self.timer, self.behind, pos, token = self.head.get() or (0, 0, NEVER, NEVER, 0, (), ())
        self.held = dict(zip(pos, token, strict=True))
        self.read, self.new = not self.behind, {}

    def _all(self) -> None:
        """What waits behind the next chunk is held too; tokens that came since are newer."""
        if not self.read:
            stored = {p: t for pos, token in self.later.get() for p, t in zip(pos, token, strict=True) if p >= self.nxt * self.m}
            self.held, self.read = {**stored, **self.held}, True

    def _store(self, wake: int) -> None:
        """Only tokens that came are written, or all that wait where they are the lesser part of what is stored."""
        end = (self.nxt + 1) * self.m
        new = {p: t for p, t in self.new.items() if p >= end}
        waits = {p: t for p, t in self.held.items() if p >= end} if self.read else {}
        if self.behind and self.read and 2 * len(waits) < self.behind:
            self.later.clear()
            self.behind, new = 0, waits
        if new:
            self.later.appendValue((list(new), list(new.values())))
            self.behind += len(new)
        at = -(-wake // 1000)  # timers are in milliseconds
        if at != self.timer:
            if self.timer != NEVER:
                self.handle.deleteTimer(self.timer)
            self.handle.registerTimer(at)
        own = {p: t for p, t in self.held.items() if p < end}
        self.head.update((self.nxt, self.late, self.last, at, self.behind, list(own), list(own.values())))

    def _ready(self) -> list[tuple]:
        """The next chunks, as long as they are complete."""
        out = []
        while all(self.nxt * self.m + i in self.held for i in range(self.m)):
            self._all()
            out.append((self.nxt, " ".join(self.held.pop(self.nxt * self.m + i) for i in range(self.m)), COMPLETE, self.m))
            self.nxt += 1
        return out

    def _close(self) -> list[tuple]:
        """Every chunk that has a token, then the count of late ones."""
        self._all()
        out = []
        for chunk in sorted({p // self.m for p in self.held}):
            own = [self.held[p] for p in range(chunk * self.m, (chunk + 1) * self.m) if p in self.held]
            out.append((chunk, " ".join(own), COMPLETE if len(own) == self.m else INCOMPLETE, len(own)))
            self.nxt = chunk + 1
        if self.late:
            out.append((None, None, LATE, self.late))
        self.held, self.late, self.last = {}, 0, NEVER
        return out

    @staticmethod
    def _rows(key: tuple, out: list[tuple]) -> Iterator[Row]:
        return (Row(key=key[0], chunk=chunk, text=text, status=status, n=n) for chunk, text, status, n in out)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load()
        out: list[tuple] = []
        for at, pos, token in sorted(((r.at, r.pos, r.token) for r in rows), key=lambda r: (r[0], r[1])):
            if self.last != NEVER and at - self.last > self.patience:
                out += self._close()
            self.last = max(self.last, at)
            if pos < self.nxt * self.m:
                self.late += 1
            else:
                self.held[pos] = self.new[pos] = token
                if pos // self.m == self.nxt:
                    out += self._ready()
        self._store(self.last + self.patience)
        return self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        self.timer = NEVER if self.timer == expiredTimerInfo.getExpiryTimeInMs() else self.timer
        if self.last == NEVER:
            self.head.clear()
            self.later.clear()
            return iter(())
        wake = self.last + self.patience + self.forget
        out = self._close()
        self._store(wake)
        return self._rows(key, out)

    def close(self) -> None:
        pass


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def chunk_stream(tokens: DataFrame, m: int, patience: str, delay: str = "0 seconds", forget: str = "365 days") -> DataFrame:
    """CHUNKS of a stream of tokens (key long, pos long, token, ts), as `chunk_sessions` gives them of a table.

    A chunk goes out once all before it are out, or once its key is closed: no token for `patience` of event time, by the watermark or by the
    key's own next token. `delay` is how late rows may be; a row as old as the newest one less that is dropped. The stream needs the RocksDB state store: `drained` sets it for the
    time that it runs.
    """
    own = tokens.select("key", "pos", "token", F.unix_micros("ts").alias("at"), "ts").withWatermark("ts", delay)
    return own.groupBy("key").transformWithState(ChunkProcessor(m, _micros(patience), _micros(forget)), CHUNKS, "append", "EventTime")


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta("1us"))


def chunk_sessions(tokens: DataFrame, m: int, patience: str, delay: str = "0 seconds") -> DataFrame:
    """The batch twin of `chunk_stream` for tokens that come in the order of ts, positions rising with it: CHUNKS.

    A key's tokens fall into stretches where patience runs out between two of them. All chunks of a stretch go out that lie behind the stretch before; of the last
    one only those complete from its first on, unless patience has run out for it as well when the stream ends.
    """
    order = Window.partitionBy("key").orderBy("at", "pos")
    gap = F.coalesce((F.col("at") - F.lag("at").over(order) > _micros(patience)).cast("int"), F.lit(0))
    rows = tokens.select("key", "pos", "token", F.unix_micros("ts").alias("at")).withColumn("_gap", gap).withColumn("part", F.sum("_gap").over(order))
    stretches = rows.groupBy("key", "part").agg(F.max("pos").alias("top"), F.max("at").alias("last"))
    ahead = Window.partitionBy("key").orderBy("part")
    end = rows.agg((F.max("at") - _micros(delay)).alias("end"))
    first = F.coalesce(F.floor(F.max("top").over(ahead.rowsBetween(Window.unboundedPreceding, -1)) / m) + 1, F.lit(0)).cast("long")
    closed = F.lead("part").over(ahead).isNotNull() | (F.col("last") + _micros(patience) <= F.col("end"))
    known = stretches.join(F.broadcast(end)).select("key", "part", first.alias("first"), closed.alias("closed"))  # end is one row
    placed = rows.join(known, ["key", "part"]).withColumn("chunk", F.floor(F.col("pos") / m).cast("long"))
    late = placed.where("closed and chunk < first").groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).select("key", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("string").alias("text"), F.lit(LATE).alias("status"), "n")
    chunks = placed.where("chunk >= first").groupBy("key", "part", "chunk", "first", "closed").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    whole = F.sum((F.col("n") == m).cast("int")).over(Window.partitionBy("key", "part").orderBy("chunk"))
    out = chunks.withColumn("_w", whole).where(F.col("closed") | (F.col("_w") == F.col("chunk") - F.col("first") + 1))
    text = F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("text")
    return out.select("key", "chunk", text, F.when(F.col("n") == m, COMPLETE).otherwise(INCOMPLETE).alias("status"), "n").unionByName(late)


def once_per_text(queries: DataFrame, retrieve) -> DataFrame:
    """retrieve((text) rows) joined back to queries (.., text), so equal texts are retrieved once."""
    return queries.join(retrieve(queries.select("text").distinct()), "text", "left")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a bounded stream has given when all that is available is through: written as Parquet to the shared folder, batch by batch, and read from there."""
    spark = stream.sparkSession
    at = new_folder(spark, name)
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return spark.read.schema(stream.schema).parquet(f"{at}/out")

"""Quality rules with thresholds that adapt to language and source. DataFrame functions only.

Fixed rules: fewer than 20 words, or more than 30 % of the words in repeated
windows of eight. Adaptive rules: for each metric, language and source a quantile
sketch is built, buckets of at most 1/16 relative width with their counts. Sketches
merge by adding counts, in any order and to the same result. A document is
rejected if a metric lies above the upper quartile by more than SPREAD times the
distance of the quartiles plus the metric's SLACK, so a group's usual spread is
never cut off, as a fixed quantile would. A group's fence is weighed with the fence of the sketch
merged from all groups, its own by the group's documents and the common one by SUPPORT, so small
groups lean on the whole and no number of documents switches between them.

The texts are read once: the measures are kept, the sketches are built from them, and only
counts of buckets are exchanged. The thresholds, a row for each language and source, meet the measures in
a join whose side is sent to all executors if it has at most SENT_GROUPS rows.

Defined cases: a null text has no words and fails; null languages and sources are
groups of their own; ties fall into one bucket; repeated rows count each; columns
with the names of outputs are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import GAP_PATTERN, UPPER, discard, fresh, let, materialise

RUN, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: In thousandths of the characters, lines or letters; `word_tenths` is the mean word's length in tenths.
SLACK = {"symbol_share": 50, "dup_share": 400, "upper_share": 300, "word_tenths": 60}
SPREAD, SUPPORT, SENT_GROUPS = 6, 50, 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP_PATTERN), lambda w: w != "")


def repeat_words(words: Column, run: int = RUN) -> Column:
    """Words in runs of `run` words that the text has twice or more, the first included.

    Hashes of the runs are sorted with their places; equal neighbours give the
    places that count, and each covers as far as the next one, `run` words at most.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - run + 1), lambda i: F.xxhash64(F.slice(w, i, run)))

    def places(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = let(paired, lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    def covered(p: Column) -> Column:
        begin = F.struct(F.lit(0).alias("c"), F.lit(-run).alias("at"))
        return F.aggregate(p, begin, lambda a, i: F.struct((a["c"] + F.least(F.lit(run), i - a["at"])).alias("c"), i.alias("at")), lambda a: a["c"])

    repeated = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(0)
    return let(words, lambda w: F.when(F.size(w) > run, let(hashes(w), repeated)).otherwise(0)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text_col: str, own: str) -> DataFrame:
    """docs with the contract's measures as they are named, and as `own` + name those of SLACK."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words, counts, upper = f"{own}words", f"{own}lines", f"{own}upper"
    found = docs.withColumns({
        words: F.transform(words_of(text), lambda w: F.xxhash64(w)),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": _without(text, SYMBOLS).cast("long"),
        counts: let(lines, lambda x: F.array(F.size(x), F.size(F.array_distinct(x)))),
        upper: _without(text, UPPER).cast("long"),
    })
    found = found.withColumns({"n_words": F.size(words).cast("long"), "n_dup_lines": (F.col(counts)[0] - F.col(counts)[1]).cast("long"), "n_repeat_words": repeat_words(F.col(words)), f"{own}n_lines": F.col(counts)[0].cast("long")})
    share = lambda a, b, scale: F.expr(f"cast({scale} * `{a}` div greatest(1, `{b}`) as bigint)")
    shares = {"symbol_share": share("n_symbols", "word_chars", 1000), "dup_share": share("n_dup_lines", f"{own}n_lines", 1000), "upper_share": share(upper, "word_chars", 1000), "word_tenths": share("word_chars", "n_words", 10)}
    return found.withColumns({f"{own}{m}": c for m, c in shares.items()}).drop(words, counts, upper, f"{own}n_lines")


def bucket(v: str) -> str:
    """SQL of a value's bucket: the value itself below 32, else with its five leading bits kept."""
    return f"case when {v} < 32 then {v} else {v} - {v} % shiftleft(1L, length(bin({v})) - 5) end"


def sketches(found: DataFrame, groups: list[str], own: str = "") -> DataFrame:
    """(groups..., metric, bucket, n) of found's columns own + metric. Sketches of parts are merged by summing n."""
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(bucket(f"`{own}{m}`")).alias("bucket")) for m in SLACK])).alias("m")
    return found.select(*groups, metric).groupBy(*groups, "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    w = Window.partitionBy(*groups, "metric")
    summed = sketch.select(*groups, "metric", "bucket", F.sum("n").over(w.orderBy("bucket")).alias("c"), F.sum("n").over(w).alias("total"))
    found = summed.groupBy(*groups, "metric").agg(*[F.min(F.when(4 * F.col("c") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}") for k in (1, 3)], F.max("total").alias("total"))
    limit = reduce(lambda a, m: a.when(F.col("metric") == m, SLACK[m]), SLACK, F.when(F.lit(False), 0))
    return found.select(*groups, "metric", "total", (F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")) + limit).alias("fence"))


def thresholds(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """A row for each group: the fence of every metric as _metric. sketch is read twice."""
    own = _quartiles(sketch, groups)
    merged = _quartiles(sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [])
    both = own.join(F.broadcast(merged.select("metric", F.col("fence").alias("common"))), "metric")  # a row for each metric
    fence = F.expr(f"(total * fence + {SUPPORT} * common) div (total + {SUPPORT})")
    return both.groupBy(*groups).agg(*[F.max(F.when(F.col("metric") == m, fence)).alias(f"_{m}") for m in SLACK])


def quality_rules(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), keep_text: bool = True) -> DataFrame:
    """docs, without the text unless keep_text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    outputs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    given = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in outputs])
    own = fresh(given, "_q")
    columns = [f"`{c}`" for c in given.columns if keep_text or c != text_col]
    keys = [f"{own}g{i}" for i in range(len(groups))]
    grouped = given.withColumns({k: F.col(f"`{g}`") for k, g in zip(keys, groups, strict=True)})
    found = measured(grouped, text_col, own)
    found = materialise(found if keep_text else found.drop(F.col(f"`{text_col}`")))
    sketch = materialise(sketches(found, keys, own))
    limits = materialise(thresholds(sketch, keys).withColumnsRenamed({**{k: f"{k}t" for k in keys}, **{f"_{m}": f"{own}_{m}" for m in SLACK}}))
    discard(sketch)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}t")) for k in keys])
    judged = found.join(F.broadcast(limits) if limits.count() <= SENT_GROUPS else limits, same, "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    beyond = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{own}{m}") > F.col(f"{own}_{m}"), F.lit(False)) for m in SLACK])
    return judged.select(*columns, *outputs[:5], failed.alias("base_failed"), (~failed & ~beyond).alias("kept"))

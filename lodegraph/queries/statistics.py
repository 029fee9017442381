"""Queries of the evaluation statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import BEGIN, END
from lodegraph.operators import perturb
from lodegraph.operators import stats as s
from lodegraph.queries.text import BORDERED
from lodegraph.registry import query
from lodegraph.sources.tables import table


@query("SELECT event_type, round(coalesce(avg(CASE WHEN value > 10 THEN value END), 0), 5) AS mean, count(*) AS n, count(CASE WHEN value > 10 THEN value END) AS scored FROM events GROUP BY 1")
def arm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: mean metric of each arm without the missing values."""
    e = table(spark, sf_dir, "events").withColumn("m", F.when(F.col("value") > 10, F.col("value")))
    return e.groupBy("event_type").agg(F.round(s.mean("m"), 5).alias("mean"), F.count(F.lit(1)).alias("n"), F.count("m").alias("scored"))


@query("""WITH r AS (SELECT o_custkey AS item, o_orderpriority AS cand, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
t AS (SELECT c_custkey AS item, c_mktsegment FROM customer), h AS (SELECT item, min(rank) AS first FROM r WHERE cand = '1-URGENT' GROUP BY 1)
SELECT c_mktsegment AS segment, k, round(avg(coalesce(first <= k, false)::INT), 6) AS recall, count(*) AS n FROM t LEFT JOIN h USING (item), (VALUES (1), (3), (5), (10)) v(k) GROUP BY 1, 2""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By market segment, whether an urgent order is among a customer's k largest."""
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("cand"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("segment"))
    hits = s.recall_at(r, c.select("item", F.lit("1-URGENT").alias("cand")), "item", "cand", [1, 3, 5, 10])
    return hits.join(c, "item").groupBy("segment", "k").agg(F.round(F.avg("hit"), 6).alias("recall"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(*) AS n FROM lineitem GROUP BY 1")
def rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact linear percentiles."""
    p = lambda q: F.round(F.percentile("l_extendedprice", F.lit(q)), 4)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(p(0.5).alias("median"), p(0.9).alias("p90"), F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT DISTINCT l_suppkey AS rel, l_partkey AS name FROM lineitem WHERE l_linestatus = 'F'), e AS (SELECT l_suppkey AS rel, l_partkey AS name FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT rel, count(*) AS matched FROM g SEMI JOIN e USING (rel, name) GROUP BY 1), sp AS (SELECT rel, count(*) AS spurious FROM e ANTI JOIN g USING (rel, name) GROUP BY 1), n AS (SELECT rel, count(*) AS gold FROM g GROUP BY 1)
SELECT rel, gold, coalesce(matched, 0) AS matched, coalesce(spurious, 0) AS spurious, round(coalesce(matched, 0) / gold::DOUBLE, 6) AS coverage FROM n LEFT JOIN m USING (rel) LEFT JOIN sp USING (rel)""")
def coverage_by_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each supplier's gold parts the share that was emitted; what was emitted besides is kept with duplicates."""
    li = table(spark, sf_dir, "lineitem")
    gold = li.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("rel"), F.col("l_partkey").alias("name")).distinct()
    out = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("rel"), F.col("l_partkey").alias("name"))
    count = lambda d, n: d.groupBy("rel").agg(F.count(F.lit(1)).alias(n))
    both = count(gold, "gold").join(count(gold.join(out, ["rel", "name"], "left_semi"), "matched"), "rel", "left").join(count(out.join(gold, ["rel", "name"], "left_anti"), "spurious"), "rel", "left").na.fill(0)
    return both.select("rel", "gold", "matched", "spurious", F.round(F.col("matched") / F.col("gold"), 6).alias("coverage"))


@query("""WITH a AS (SELECT o_custkey AS item, CASE WHEN o_totalprice > 300000 THEN 'RIGHT' WHEN o_totalprice > 100000 THEN 'WRONG' ELSE 'MISSING' END AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
p AS (SELECT x.st AS before, y.st AS after FROM a x JOIN a y USING (item) WHERE x.k = 1 AND y.k = 2)
SELECT before, count(*) FILTER (after = 'RIGHT') AS "RIGHT", count(*) FILTER (after = 'WRONG') AS "WRONG", count(*) FILTER (after = 'MISSING') AS "MISSING" FROM p GROUP BY 1""")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a customer's status moves from the first order to the second."""
    status = F.when(F.col("o_totalprice") > 300000, "RIGHT").when(F.col("o_totalprice") > 100000, "WRONG").otherwise("MISSING").alias("st")
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), status, F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("k"))
    return s.transitions(a.where("k = 1"), a.where("k = 2"), "item", "st", ["RIGHT", "WRONG", "MISSING"])


@query("""WITH x AS (SELECT l_shipmode AS g, l_quantity AS v, l_returnflag = 'R' AS pos FROM (SELECT l_linestatus AS l_shipmode, l_quantity, l_returnflag FROM lineitem)),
t AS (SELECT g, v, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM x GROUP BY 1, 2), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT g, round(sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc FROM b GROUP BY 1""")
def auc_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quantity tells returned lines, ties half."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_quantity").alias("v"), (F.col("l_returnflag") == "R").alias("pos"))
    return s.auc(x, ["g"], "v", "pos").select("g", F.round("auc", 6).alias("auc"))


@query("""SELECT l_linestatus AS g, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS mean_true, round(avg(l_extendedprice) FILTER (l_returnflag <> 'R'), 4) AS mean_false, round(avg(l_extendedprice) FILTER (l_returnflag = 'R') - avg(l_extendedprice) FILTER (l_returnflag <> 'R'), 4) AS gap FROM lineitem GROUP BY 1""")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of the true and the false, and their gap."""
    m = lambda c: F.avg(F.when(c, F.col("l_extendedprice")))
    t, f = m(F.col("l_returnflag") == "R"), m(F.col("l_returnflag") != "R")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("g")).agg(F.round(t, 4).alias("mean_true"), F.round(f, 4).alias("mean_false"), F.round(t - f, 4).alias("gap"))


@query("""WITH l AS (SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, event_id, round(value - nxt, 6) AS margin FROM l WHERE k % 2 = 1 AND nxt IS NOT NULL""")
def paired_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of adjacent pairs of each user's events."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lead("value").over(w).alias("nxt"), F.row_number().over(w).alias("k"))
    return e.where("k % 2 = 1 and nxt is not null").select("user_id", "event_id", F.round(F.col("value") - F.col("nxt"), 6).alias("margin"))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean difference between a customer's balance and the suppliers' mean of the nation."""
    m = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("m"))
    d = table(spark, sf_dir, "customer").join(m, F.col("s_nationkey") == F.col("c_nationkey")).select((F.col("c_acctbal") - F.col("m")).alias("d"))
    return s.bootstrap(d, "d")


@query()
def mean_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the mean value of all events."""
    return s.bootstrap_mean(table(spark, sf_dir, "events"), "value")


@query("""WITH x AS (SELECT c_mktsegment AS g, count(*) FILTER (c_acctbal > 0 AND c_nationkey < 5) AS b, count(*) FILTER (c_acctbal <= 0 AND c_nationkey >= 5) AS c FROM customer GROUP BY 1),
t AS (SELECT g, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM x) SELECT g, b, c, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)))), 6) AS p FROM t GROUP BY ALL""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact test of discordant counts by segment."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.count(F.when((F.col("c_acctbal") > 0) & (F.col("c_nationkey") < 5), 1)).alias("b"), F.count(F.when((F.col("c_acctbal") <= 0) & (F.col("c_nationkey") >= 5), 1)).alias("c"))
    return c.select("g", "b", "c", F.round(s.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query("""WITH x AS (SELECT c_nationkey AS g, count(*) FILTER (c_acctbal > 5000) AS h, count(*) AS n FROM customer GROUP BY 1), y AS (SELECT *, h / n::DOUBLE AS p FROM x)
SELECT g, round(greatest(0, ((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS low, round(least(1, ((p + 3.8416 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM y""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rich customers in each nation with its interval."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count(F.when(F.col("c_acctbal") > 5000, 1)).alias("h"), F.count(F.lit(1)).alias("n"))
    low, high = s.wilson(F.col("h"), F.col("n"))
    return c.select("g", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH t AS (SELECT n_regionkey AS fam, n_nationkey AS name, ((n_nationkey * 37 + 11) % 100) / 1000.0::DOUBLE AS p FROM nation), k AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, name) AS i, count(*) OVER (PARTITION BY fam) AS m FROM t)
SELECT fam, name, p, round(max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY fam ORDER BY p, name), 6) AS adjusted FROM k""")
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of a family corrected step by step."""
    t = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("fam"), F.col("n_nationkey").alias("name"), (((F.col("n_nationkey") * 37 + 11) % 100) / 1000.0).alias("p"))
    return s.holm(t, ["fam"], "p", "name").withColumn("adjusted", F.round("adjusted", 6))


@query("SELECT c_mktsegment AS g, round(2.8 * stddev_samp(c_acctbal) / sqrt(count(*)), 4) AS mde, ceil(pow(2.8 * stddev_samp(c_acctbal) / 100, 2))::BIGINT AS n FROM customer GROUP BY 1")
def power_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least effect that can be seen, and the items that one of 100 needs."""
    sd = F.stddev_samp("c_acctbal")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.round(s.detectable(sd, F.count(F.lit(1))), 4).alias("mde"), s.required_n(sd, F.lit(100.0)).alias("n"))


@query("""WITH c AS (SELECT c_mktsegment, count(*) AS c FROM customer GROUP BY 1), q AS (SELECT c_mktsegment, greatest(1, round_even(50.0::DOUBLE * c / (SELECT sum(c) FROM c), 0)) AS q FROM c),
k AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey || 'a'), c_custkey) AS k FROM customer) SELECT c_mktsegment, c_custkey FROM k JOIN q USING (c_mktsegment) WHERE k <= q""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample in proportion to the segments."""
    return s.stratified(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 50, "a")


@query("""WITH k AS (SELECT c_nationkey, c_custkey, sha256(c_custkey || 'b') AS h, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(c_custkey || 'b'), c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey FROM k WHERE k <= 3 ORDER BY h, c_custkey LIMIT 40""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample with quotas by nation and in all."""
    return s.quota_sample(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 3, 40, "b")


@query("""WITH m AS (SELECT event_type AS run, date_trunc('day', ts)::DATE AS day, round(avg(value), 6) AS m FROM events GROUP BY 1, 2)
SELECT a.run, a.day, a.m, b.m AS base, round(a.m - b.m, 5) AS gain FROM m a LEFT JOIN m b ON b.run = 'click' AND a.day = b.day WHERE a.run <> 'click'""")
def suite_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's mean of every run against the baseline's."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("m"))
    return s.compared(m, "run", "click", ["day"], "m").withColumn("gain", F.round("gain", 5))


@query("""SELECT o_orderpriority AS arm, round(sum(o_totalprice), 2) AS cost, count(*) FILTER (o_orderstatus = 'F') AS correct, round(sum(o_totalprice) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0), 4) AS each FROM orders GROUP BY 1""")
def cost_per_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a correct answer, null without one."""
    right = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"), right.alias("correct"), F.round(F.sum("o_totalprice") / F.nullif(right, F.lit(0)), 4).alias("each"))


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders), b AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT CASE WHEN abs(o_totalprice - v) <= 0.001 * abs(o_totalprice) THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM a JOIN b USING (o_orderkey) GROUP BY 1
UNION ALL SELECT 'LEAKED', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT s_suppkey FROM supplier)""")
def audit_rederivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals derived again within a tolerance, and ids in both of two sets."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    j = table(spark, sf_dir, "orders").join(b, "o_orderkey")
    ok = F.abs(F.col("o_totalprice") - F.col("v")) <= 0.001 * F.abs("o_totalprice")
    audit = j.groupBy(F.when(ok, "PASS").otherwise("FAIL").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    leaked = table(spark, sf_dir, "orders").select("o_custkey").intersect(table(spark, sf_dir, "supplier").select("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    return audit.unionByName(leaked.select(F.lit("LEAKED").alias("verdict"), "n"))


@query("SELECT p_type AS defect, count(DISTINCT l_suppkey) AS affected, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1")
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many suppliers each kind of return affects."""
    j = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(F.col("p_type").alias("defect")).agg(F.countDistinct("l_suppkey").alias("affected"), F.count(F.lit(1)).alias("n"))


@query(f"WITH k AS (SELECT unnest(regexp_extract_all(text, '\\b[A-Z][a-z]{{2,}}\\b')) AS kind FROM {BORDERED}) SELECT kind, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 20")
def schema_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised kinds that occur often enough."""
    k = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(BEGIN + "[A-Z][a-z]{2,}" + END), 0)).alias("kind"))
    return k.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


def _draw(seed: str, salt: str) -> str:
    return f"('0x' || substr(md5({seed} || '{salt}'), 1, 8))::BIGINT"


def _replaced(old: str, new: str) -> str:
    return f"CASE WHEN contains(text, {old}) THEN substr(text, 1, instr(text, {old}) - 1) || {new} || substr(text, instr(text, {old}) + length({old})) END"


_ID = "fact_id::VARCHAR"
PERTURBED_SQL = f"""WITH f AS (SELECT o_orderkey AS fact_id, 'Order ' || o_orderkey || ' of ' || c_mktsegment || ' cost ' || o_totalprice || ' and ' || CASE WHEN o_orderstatus = 'F' THEN 'is' ELSE 'was' END || ' sent to ' || n_name || ' from ' || o_orderpriority AS text
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT *, regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b') AS nums, list_filter(regexp_extract_all(text, '\\b[A-Z][a-zA-Z]{{3,}}\\b'), lambda x: lower(x) NOT IN ('the', 'this', 'that', 'these', 'there', 'when', 'what')) AS names FROM f),
t AS (SELECT *, nums[{_draw(_ID, "number")} % len(nums) + 1] AS num, names[{_draw(_ID, "name")} % len(names) + 1] AS name FROM m),
v AS (SELECT *, CASE WHEN num::DOUBLE = floor(num::DOUBLE) THEN (num::DOUBLE * 5 + 7)::BIGINT::VARCHAR ELSE printf('%.1f', num::DOUBLE * 5 + 7) END AS new FROM t),
own AS (SELECT name, CASE WHEN min(fact_id) = max(fact_id) THEN min(fact_id) END AS owner FROM (SELECT fact_id, unnest(names) AS name FROM m) GROUP BY 1),
pool AS (SELECT name, owner, row_number() OVER (ORDER BY owner IS NOT NULL, owner, name) - 1 AS number, count(*) OVER () AS total FROM own),
span AS (SELECT owner AS fact_id, min(number) AS begin, count(*) AS width FROM pool WHERE owner IS NOT NULL GROUP BY 1),
d AS (SELECT v.fact_id, text, v.name, p.number AS at_, p.total, p.owner IS NULL AS out_, coalesce(begin, total) AS begin, coalesce(width, 0) AS width FROM v JOIN pool p ON p.name = v.name LEFT JOIN span s ON s.fact_id = v.fact_id),
r AS (SELECT *, {_draw(_ID, "other")} % (total - width - out_::INT) AS r FROM d WHERE total - width - out_::INT > 0),
q AS (SELECT *, CASE WHEN out_ AND r >= at_ THEN r + 1 ELSE r END AS x FROM r),
e AS (SELECT q.fact_id, {_replaced("q.name", "o.name")} AS entity FROM q JOIN pool o ON o.number = CASE WHEN x >= begin THEN x + width ELSE x END),
n AS (SELECT fact_id, row_number() OVER (ORDER BY fact_id) - 1 AS number, count(*) OVER () AS total, string_split(text, ' ') AS w FROM f),
g AS (SELECT a.fact_id, array_to_string(list_concat(a.w[1:len(a.w) // 2], b.w[len(b.w) // 2 + 1:]), ' ') AS swap FROM n a JOIN n b ON b.number = (a.number + {_draw("a.fact_id::VARCHAR", "graft")} % (a.total - 1) + 1) % a.total WHERE len(a.w) > 6 AND len(b.w) > 6),
k AS (SELECT v.fact_id, {_replaced("num", "new")} AS numeric, entity, coalesce({_replaced("' is '", "' is not '")}, {_replaced("' was '", "' was not '")}) AS negation, swap FROM v LEFT JOIN e ON e.fact_id = v.fact_id LEFT JOIN g ON g.fact_id = v.fact_id),
o AS (SELECT *, list_sort(list_filter([{", ".join("{'o': " + _draw(_ID, x) + f", 'kind': '{x}', 'variant': " + ('"numeric"' if x == "numeric" else x) + "}" for x in ("numeric", "entity", "negation", "swap"))}], lambda s: s.variant IS NOT NULL))[1] AS first FROM k)
SELECT fact_id, "numeric", entity, negation, swap, first.kind AS kind, first.variant AS variant FROM o"""


@query(PERTURBED_SQL)
def perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False variants of a fact of each order: a number, a name, the statement or the second half changed."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    verb = F.when(F.col("o_orderstatus") == "F", "is").otherwise("was")
    price = F.col("o_totalprice").cast("decimal(15,2)").cast("string") if dict(o.dtypes)["o_totalprice"].startswith("decimal") else F.col("o_totalprice").cast("string")
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), "c_mktsegment", F.lit(" cost "), price, F.lit(" and "), verb, F.lit(" sent to "), "n_name", F.lit(" from "), "o_orderpriority")
    return perturb.variants(o.select(F.col("o_orderkey").alias("fact_id"), text.alias("text"))).drop("text")


def _cut(a: str, b: str) -> str:
    """Characters a to b, end exclusive, of name."""
    return f"substr(name, ({a}) + 1, greatest(({b}) - ({a}), 0))"


def _at(kind: str, end: int) -> str:
    return f"({_draw('k::VARCHAR', kind)} % greatest(length(name) - {end} - 1, 1) + 1)"


DEGRADED_SQL = f"""WITH p AS (SELECT p_partkey AS k, p_name AS name FROM part), i AS (SELECT *, {_at("char_swap", 2)} AS s, {_at("char_drop", 1)} AS d, {_at("char_double", 1)} AS t FROM p)
SELECT k AS p_partkey, name AS exact, lower(name) AS lowercase, CASE WHEN length(name) < 4 THEN name ELSE {_cut("0", "s")} || {_cut("s + 1", "s + 2")} || {_cut("s", "s + 1")} || {_cut("s + 2", "length(name)")} END AS char_swap,
CASE WHEN length(name) < 4 THEN name ELSE {_cut("0", "d")} || {_cut("d + 1", "length(name)")} END AS char_drop, CASE WHEN length(name) < 3 THEN name ELSE {_cut("0", "t")} || {_cut("t", "t + 1")} || {_cut("t", "length(name)")} END AS char_double,
substr(name, 1, greatest(4, length(name) * 3 // 4)) AS truncated, string_split(name, ' ')[-1] AS surname,
CASE WHEN contains(name, ' ') THEN array_to_string(list_transform(string_split(name, ' ')[:-2], lambda w: w[1] || '.'), ' ') || ' ' || string_split(name, ' ')[-1] ELSE name END AS initials FROM i"""


@query(DEGRADED_SQL)
def degraded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name misspelt in each way, and shortened as names of persons are."""
    p = table(spark, sf_dir, "part")
    name, seed = F.col("p_name"), F.col("p_partkey").cast("string")
    return p.select("p_partkey", *[perturb.degraded(name, k, seed).alias(k) for k in perturb.DEGRADED], *[perturb.renamed(name, k).alias(k) for k in ("surname", "initials")])


@query("""WITH e AS (SELECT label, vec_id FROM embeddings), v AS (SELECT p_partkey AS vec_id FROM part WHERE p_size < 25) SELECT label, round(count(*) FILTER (v.vec_id IS NULL) / count(*)::DOUBLE, 6) AS invented FROM e LEFT JOIN v USING (vec_id) GROUP BY 1""")
def invented_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of emitted names that the vocabulary lacks."""
    v = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("vec_id"), F.lit(1).alias("known"))
    return table(spark, sf_dir, "embeddings").join(v, "vec_id", "left").groupBy("label").agg(F.round(F.count(F.when(F.col("known").isNull(), 1)) / F.count(F.lit(1)), 6).alias("invented"))


@query("""WITH a AS (SELECT n_name AS db, count(*) AS questions, count(*) FILTER (c_acctbal > 0) AS correct FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), t AS (FROM a UNION ALL SELECT 'TOTAL', sum(questions)::BIGINT, sum(correct)::BIGINT FROM a)
SELECT db, questions, correct, round(correct / questions::DOUBLE, 6) AS accuracy FROM t""")
def accuracy_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: accuracy of each group and of all."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("db"), F.lit(1).cast("long").alias("questions"), (F.col("c_acctbal") > 0).cast("long").alias("correct"))
    return s.grand_total(c, "db", ["questions", "correct"]).withColumn("accuracy", F.round(F.col("correct") / F.col("questions"), 6))


@query("""WITH r AS (SELECT n_name AS db, count(*) AS now FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0 GROUP BY 1), p AS (SELECT upper(n_name) AS db, count(*) AS prior FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY 1)
SELECT r.db, now, prior, now - prior AS change FROM r LEFT JOIN p ON upper(r.db) = p.db""")
def prior_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: current results against prior ones, where there are any."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("db"))
    now = table(spark, sf_dir, "supplier").where("s_acctbal > 0").join(n, F.col("n_nationkey") == F.col("s_nationkey")).groupBy("db").agg(F.count(F.lit(1)).alias("now"))
    prior = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(n, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.upper("db").alias("k")).agg(F.count(F.lit(1)).alias("prior"))
    return now.join(prior, F.upper("db") == F.col("k"), "left").select("db", "now", "prior", (F.col("now") - F.col("prior")).alias("change"))


@query("""WITH s AS (SELECT c_mktsegment AS name, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2), r AS (SELECT c_nationkey, name, round(n / nullif(sum(n) OVER (PARTITION BY name), 0)::DOUBLE, 6) AS share FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY share DESC, name) AS k FROM r) SELECT c_nationkey, name, share FROM k WHERE k = 1""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each nation, the segment of which it holds the largest share."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    share = n.withColumn("share", F.round(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("name")), F.lit(0)), 6))
    return share.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("share"), "name"))).where("k = 1").select("c_nationkey", "name", "share")


@query("""WITH a AS (SELECT o_custkey FROM orders), b AS (SELECT DISTINCT o_custkey FROM orders)
SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT FROM a)) = 0 AS same_set, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) + (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) = 0 AS same_bag""")
def result_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: whether two results are equal, as sets and as bags."""
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return s.set_equal(o, o.distinct())


@query("""SELECT r_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def gold_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts over a five-table join."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.countDistinct("c_custkey").alias("customers"), F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))

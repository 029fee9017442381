"""Queries of the text functions over the text tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text as t
from lodegraph.operators.similarity import similar_sets
from lodegraph.registry import query
from lodegraph.sources.tables import table

PLAIN = "translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
NORM = "array_to_string(list_filter(regexp_split_to_array(" + PLAIN + ", '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"
TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in t.STOPWORDS) + "]"
CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + STOP + ", w)))"
ANSWERS = "list_filter(list_transform(regexp_split_to_array({0}, ',|;|/|\\n|\\band\\b'), lambda x: " + NORM.format("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> '')"
SETS = "list_distinct(" + ANSWERS + ")"
#: documents with _ for letters and digits outside ASCII, beside which SQL's \b would see a border.
BORDERED = "(SELECT doc_id, regexp_replace(text, '[^\\P{L}A-Za-z]|[^\\P{N}0-9]', '_', 'g') AS text FROM documents)"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS normal FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers' normal form of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.normalize_answer(F.col("text"))).alias("normal"))


@query(f"SELECT a.p_partkey, ({NORM.format('a.p_name')} = {NORM.format('b.p_name')})::INT AS em FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def text_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a part's name against the next one's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(q, "p_partkey").select("p_partkey", t.exact_match(F.col("p_name"), F.col("other")).alias("em"))


@query(f"""WITH c AS (SELECT conv_id, turn, list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS p, b.w AS g FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
s AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS n FROM p)
SELECT conv_id, turn, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * n / (len(p) + len(g)) END, 6) AS f1 FROM s""")
def text_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each turn against the next one."""
    c = table(spark, sf_dir, "conversations")
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(t.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))


@query("""WITH g AS (SELECT l_orderkey, list(l_partkey) AS gold, list(l_partkey) FILTER (l_returnflag = 'R') AS ret FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(len(list_filter(gold, lambda x: list_contains(coalesce(ret, []), x))) / len(gold)::DOUBLE, 6) AS recall FROM g""")
def text_supporting_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of each order's parts, duplicates counted, the share among the returned ones."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("gold"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("ret"))
    return g.select("l_orderkey", F.round(t.supporting_recall(F.col("gold"), F.col("ret")), 6).alias("recall"))


@query(f"""WITH p AS (SELECT p_partkey, p_name || ', ' || p_type || ' and ' || p_brand AS pred, p_type || '; ' || p_name AS gold FROM part),
s AS (SELECT p_partkey, {ANSWERS.format('pred')}[1] AS first, {SETS.format('pred')} AS p, {SETS.format('gold')} AS g FROM p)
SELECT p_partkey, coalesce(list_contains(g, first), false)::INT AS hits1, round(CASE WHEN len(list_intersect(p, g)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END, 6) AS f1 FROM s""")
def text_answer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer lists made of part columns, scored as sets."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type", F.lit(" and "), "p_brand").alias("pred"), F.concat("p_type", F.lit("; "), "p_name").alias("gold"))
    return p.select("p_partkey", t.hits_at_1(F.col("pred"), F.col("gold")).alias("hits1"), F.round(t.set_f1(F.col("pred"), F.col("gold")), 6).alias("f1"))


@query(f"""WITH w AS (SELECT conv_id, {CONTENT.format("string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant')")} AS a, {CONTENT.format("string_agg(text, ' ' ORDER BY turn) FILTER (role <> 'assistant')")} AS e FROM conversations GROUP BY 1)
SELECT conv_id, round(CASE WHEN len(coalesce(a, [])) = 0 THEN 1.0::DOUBLE WHEN len(coalesce(e, [])) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, e)) / len(a)::DOUBLE END, 6) AS grounded FROM w""")
def text_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how much of the assistant's words the other turns of a conversation have."""
    c = table(spark, sf_dir, "conversations")
    said = lambda who: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(who, F.struct("turn", "text")))), lambda x: x["text"]), " ")
    w = c.groupBy("conv_id").agg(said(F.col("role") == "assistant").alias("a"), said(F.col("role") != "assistant").alias("e"))
    return w.select("conv_id", F.round(t.groundedness(F.col("a"), F.col("e")), 6).alias("grounded"))


@query(f"""SELECT i.item_id, d.doc_id, len(list_intersect({CONTENT.format('i.text')}, d.w)) AS shared FROM benchmark i JOIN (SELECT doc_id, {CONTENT.format('text')} AS w FROM documents) d
ON len({CONTENT.format('i.text')}) > 0 AND len(list_intersect({CONTENT.format('i.text')}, d.w)) >= 0.6 * len({CONTENT.format('i.text')})""")
def text_fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which documents cover which benchmark items' content words. The items are a stated query set; words find candidates."""
    items = table(spark, sf_dir, "benchmark").select("item_id", t.content_words(F.col("text")).alias("w"))
    need = items.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    have = table(spark, sf_dir, "documents").select("doc_id", F.explode(t.content_words(F.col("text"))).alias("word"))
    shared = have.join(need, "word").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.where("shared >= 0.6 * n").select("item_id", "doc_id", "shared")


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS a, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS b, len(regexp_extract_all(lower(text), '[a-z0-9_'']+')) AS c, len(regexp_extract_all(text, '[a-zA-Z0-9]{3,}')) AS d FROM documents""")
def text_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: how many tokens each tokenizer finds."""
    x = F.col("text")
    n = lambda c: F.size(c).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(t.tokens(x)).alias("a"), n(t.tokens(x, "[a-z0-9_]+")).alias("b"), n(t.tokens(x, "[a-z0-9_']+")).alias("c"), n(F.regexp_extract_all(x, F.lit("[a-zA-Z0-9]{3,}"), 0)).alias("d"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 0 THEN range(0, greatest(len(w) - 21, 0) + 1, 180) ELSE [] END) AS s FROM w)
SELECT doc_id, s AS first_word, md5(array_to_string(w[s + 1:s + 200], ' ')) AS chunk FROM s""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """windows of 200 words that overlap by 20."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.word_windows(F.col("text"), 200, 20)).alias("k", "chunk"))
    return chunks.select("doc_id", (F.col("k") * 180).cast("long").alias("first_word"), F.md5("chunk").alias("chunk"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS n_words, (len(w) + 199) // 200 AS passages FROM w""")
def text_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passages of 200 words without overlap."""
    p = t.word_windows(F.col("text"), 200)
    total = F.aggregate(p, F.lit(0), lambda n, c: n + F.size(F.split(c, " ")))
    return table(spark, sf_dir, "documents").select("doc_id", total.cast("long").alias("n_words"), F.size(p).cast("long").alias("passages"))


@query("""SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\\b'), lambda x: length(x) > 3), lambda x: lower(x)))) AS titles,
len(list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Z0-9]{1,9}-\\d{1,6}\\b'))) AS tickets FROM """ + BORDERED)
def text_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capitalised runs and ticket names of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(t.title_runs(F.col("text"))).cast("long").alias("titles"), F.size(t.tickets(F.col("text"), ())).cast("long").alias("tickets"))


@query("""WITH n AS (SELECT p_partkey, '  ' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '  ' AS s FROM part),
g AS (SELECT DISTINCT p_partkey, substr(s, i, 3) AS gram FROM (SELECT p_partkey, s, unnest(range(1, length(s) - 1)) AS i FROM n)),
k AS (SELECT 'part' || p_brand AS q, p_brand, unnest(range(1, 5)) AS i FROM (SELECT DISTINCT p_brand FROM part)),
names AS (SELECT DISTINCT p_name FROM part), ng AS (SELECT DISTINCT p_name, substr(s, i, 3) AS gram FROM (SELECT p_name, '  ' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '  ' AS s, unnest(range(1, length('  ' || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '  ') - 1)) AS i FROM names)),
c AS (SELECT p_name, count(*) AS n FROM ng GROUP BY 1),
pair AS (SELECT a.p_name AS a, b.p_name AS b, count(*) AS same FROM ng a JOIN ng b ON a.gram = b.gram AND a.p_name < b.p_name GROUP BY 1, 2)
SELECT a, b, round(same / (ca.n + cb.n - same)::DOUBLE, 6) AS jaccard FROM pair JOIN c ca ON ca.p_name = a JOIN c cb ON cb.p_name = b WHERE same >= 0.45 * (ca.n + cb.n - same)""")
def text_trigram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names that are alike by their trigrams, found through shared ones."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().select(F.col("p_name").alias("id"), t.trigrams(F.col("p_name")).alias("items"))
    found = similar_sets(names, names, 0.45, ordered=True)
    return found.select("a", "b", F.round(F.col("same") / (F.col("na") + F.col("nb") - F.col("same")), 6).alias("jaccard"))


@query("""SELECT 's' || s_suppkey AS node_id, s_name || ' is located in ' || n_name || '.' AS forward, n_name || ' is home of ' || s_name || '.' AS inverse FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def text_verbalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a relation as a sentence both ways."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.format_string("%s is located in %s.", "s_name", "n_name").alias("forward"), F.format_string("%s is home of %s.", "n_name", "s_name").alias("inverse"))


@query("""SELECT event_id, props[instr(props, '{'):length(props)] AS body, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k, sha256(props) AS digest, md5(event_type)[-1:] AS last FROM events""")
def text_json_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of text, and digests."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.expr("substring(props, instr(props, '{'))").alias("body"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2("props", 256).alias("digest"), F.substring(F.md5("event_type"), -1, 1).alias("last"))


@query("""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '[;\\n]', ',', 'g'), ','), lambda x: trim(regexp_replace(x, '^[\\s*\\-0-9.)]+', ''))), lambda x: x <> '' AND len(regexp_split_to_array(x, '\\s+')) <= 4)) AS spans FROM documents""")
def text_candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: short pieces between separators."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(t.candidate_spans(F.col("text"))).cast("long").alias("spans"))


@query("""SELECT o_orderkey, CASE WHEN lower(replace(trim(substr(o_orderpriority, 3)), ' ', '_')) = 'not_specified' THEN 'none' ELSE lower(replace(trim(substr(o_orderpriority, 3)), ' ', '_')) END AS rel FROM orders""")
def text_canonical_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation names in canonical form, typos mapped."""
    return table(spark, sf_dir, "orders").select("o_orderkey", t.canonical_relation(F.expr("substr(o_orderpriority, 3)"), {"not_specified": "none"}).alias("rel"))


@query(f"""WITH q AS (SELECT item_id, list_distinct({TOKENS.format('text')}) AS q FROM benchmark), d AS (SELECT conv_id, turn, list_distinct({TOKENS.format('text')}) AS d FROM conversations)
SELECT item_id, conv_id, turn, round(len(list_intersect(q, d)) / len(q)::DOUBLE, 6) AS overlap FROM q, d WHERE len(list_intersect(q, d)) > 0""")
def text_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's share of tokens in each conversation's turns. The items are a stated query set; tokens find candidates."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(t.tokens(F.col("text"))).alias("q")).select("item_id", F.size("q").alias("n"), F.explode("q").alias("w"))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(t.tokens(F.col("text")))).alias("w"))
    return d.join(q, "w").groupBy("item_id", "conv_id", "turn", "n").agg(F.count(F.lit(1)).alias("same")).select("item_id", "conv_id", "turn", F.round(F.col("same") / F.col("n"), 6).alias("overlap"))


@query("""WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_split_to_array(x, '\\s+'))) AS n FROM s),
f AS (SELECT doc_id, 1 AS i, 1 AS a, NULL::INTEGER AS z, NULL::INTEGER AS b FROM n
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN full_now THEN coalesce(list_min(list_filter(range(a, i), lambda k: list_sum(n[k:i - 1]) <= 32)), i) ELSE a END, CASE WHEN full_now THEN i - 1 END, CASE WHEN full_now THEN a END
  FROM (SELECT f.doc_id, f.i, f.a, n.n, i > a AND coalesce(list_sum(n[a:i - 1]), 0) + n[i] > 256 AS full_now FROM f JOIN n ON n.doc_id = f.doc_id WHERE f.i <= len(n.n)) f),
c AS (SELECT doc_id, b, z, i FROM f WHERE z IS NOT NULL UNION ALL SELECT f.doc_id, a, len(n.n), i FROM f JOIN n ON n.doc_id = f.doc_id WHERE f.i = len(n.n) + 1 AND len(n.n) > 0 AND a <= len(n.n))
SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY z, i) - 1 AS chunk, array_to_string(s[b:z], ' ') AS text FROM c JOIN n ON n.doc_id = c.doc_id""")
def text_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks of whole sentences with overlap."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(t.sentence_chunks(F.col("text"))).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("long"))

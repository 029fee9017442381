"""SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from lodegraph.llm.quality_rules import SLACK, SPREAD, SUPPORT

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Each word's window starts are looked back over; a window is the digest of its words.
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS s FROM d)),
marked AS (SELECT doc_id, s, doc_id > min(doc_id) OVER (PARTITION BY h) AS later FROM win),
word AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
gone AS (SELECT word.doc_id, i, word, coalesce(bool_or(later) OVER (PARTITION BY word.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM word LEFT JOIN marked ON marked.doc_id = word.doc_id AND marked.s = word.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Pairs by shared shingles; common shingles make this slow on more than a small table. Components by least reachable id.
NEAR_DEDUP = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
f AS (SELECT x, count(*) AS df FROM t GROUP BY 1),
r AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS p FROM t JOIN f USING (x)),
pre AS (SELECT doc_id, x FROM r WHERE 5 * (n - p + 1) >= 4 * n),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.x = b.x AND a.doc_id < b.doc_id),
link AS (SELECT a, b FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least USING (doc_id)"""

#: Runs of two lines for the deletion; for longest_run, stretches of the diagonals on which equal lines meet.
LINE_DEDUP = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
run AS (SELECT doc_id, i, k, md5(array_to_string(list_transform(l[i:i + k - 1], lambda x: md5(x)), '')) AS h FROM line, (VALUES (1), (2)) t(k) WHERE i + k - 1 <= len(l)),
times AS (SELECT doc_id, i, k, count(*) OVER (PARTITION BY k, h) AS n, row_number() OVER (PARTITION BY k, h ORDER BY doc_id, i) AS place FROM run),
one_line AS (SELECT doc_id, i, hash(h) AS h FROM run WHERE k = 1),
meet AS (SELECT a.doc_id, b.doc_id AS other, a.i - b.i AS diagonal, a.i - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, a.i - b.i ORDER BY a.i) AS stretch FROM one_line a JOIN one_line b ON a.h = b.h AND (a.doc_id <> b.doc_id OR a.i <> b.i)),
longest AS (SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, count(*) AS n FROM meet GROUP BY doc_id, other, diagonal, stretch) GROUP BY 1),
two AS (SELECT doc_id, i FROM times WHERE k = 2 AND place > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM two UNION ALL SELECT doc_id, i + 1 FROM two)),
kept AS (SELECT line.doc_id, count(*) FILTER (gone.i IS NULL) AS n, string_agg(l[line.i], chr(10) ORDER BY line.i) FILTER (gone.i IS NULL) AS kept FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - n, 0)::BIGINT AS n_removed, coalesce(longest_run, 0) AS longest_run, CASE WHEN l IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN longest USING (doc_id)"""

#: The same, and single lines with a letter or a digit.
LINE_DEDUP_ALONE = LINE_DEDUP.replace("\ngone AS (", "\none AS (SELECT doc_id, i FROM times JOIN d USING (doc_id) WHERE k = 1 AND place > 1 AND regexp_matches(l[i], '[\\p{L}\\p{N}]')),\ngone AS (").replace(" FROM two)),", " FROM two UNION ALL SELECT doc_id, i FROM one)),")


def _fence(metric: str) -> str:
    return f"max(fence) FILTER (metric = '{metric}') AS _{metric}"


QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper FROM d),
v AS (SELECT *, 1000 * n_symbols // greatest(1, word_chars) AS symbol_share, 1000 * n_dup_lines // greatest(1, n_lines) AS dup_share, 1000 * upper // greatest(1, word_chars) AS upper_share, 10 * word_chars // greatest(1, n_words) AS word_tenths FROM m),
long AS (SELECT lang, source, unnest(['symbol_share', 'dup_share', 'upper_share', 'word_tenths']) AS metric, unnest([symbol_share, dup_share, upper_share, word_tenths]) AS x FROM v),
b AS (SELECT lang, source, metric, CASE WHEN x < 32 THEN x ELSE x - x % (1 << (length(bin(x)) - 5)) END AS bucket FROM long),
slack AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {x})" for k, x in SLACK.items())}) s(metric, slack)),
own AS (SELECT lang, source, metric, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3, count(*) AS total FROM b GROUP BY 1, 2, 3),
everything AS (SELECT metric, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY 1),
fence AS (SELECT lang, source, metric, (total * (o.q3 + {SPREAD} * (o.q3 - o.q1) + slack) + {SUPPORT} * (e.q3 + {SPREAD} * (e.q3 - e.q1) + slack)) // (total + {SUPPORT}) AS fence FROM own o JOIN everything e USING (metric) JOIN slack USING (metric)),
f AS (SELECT lang, source, {", ".join(_fence(k) for k in SLACK)} FROM fence GROUP BY 1, 2),
j AS (SELECT v.*, coalesce(cov.n, 0) AS n_repeat_words, {" OR ".join(f"{k} > _{k}" for k in SLACK)} AS beyond FROM v LEFT JOIN cov USING (doc_id) JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT beyond AS kept FROM j"""



def _nearest(k: int) -> str:
    """Each vector's nearest centroid after k rounds."""
    return f"""a{k} AS MATERIALIZED (SELECT k, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, c)) AS b FROM (
  SELECT k, vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k}) GROUP BY k)"""


def _moved(k: int) -> str:
    """Centroids of round k + 1: whole floors of the means, the old one for an empty cluster."""
    return f"""c{k + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM (
  SELECT c, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS x FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT b[2] AS c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY 1, 2)) GROUP BY 1) n USING (c))"""


CENTROID_CLUSTERS = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT v, sha256('3:' || vec_id) AS h FROM v) ORDER BY h LIMIT 8),
{", ".join(f"{_nearest(k)}, {_moved(k)}" for k in range(10))},
{_nearest(10)}
SELECT vec_id, b[2]::INT AS cluster, b[1] AS distance, sum(b[1]) OVER (PARTITION BY b[2])::BIGINT AS cluster_inertia, sum(b[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c = b[2]"""

ORACLES = {"op12_centroid_clusters": CENTROID_CLUSTERS, "op2_substring_dedup": SUBSTRING_DEDUP, "op3_near_dedup": NEAR_DEDUP, "op4_line_dedup": LINE_DEDUP_ALONE, "op8_quality_rules": QUALITY_RULES}

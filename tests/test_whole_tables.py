"""Queries over all rows of their tables: against plain Python, and on the part that they once read against the SQL of that part."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodegraph.queries import QUERIES
from tests.compare import same, views
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return views(SMALL)


def test_paired_margins_of_all_users(spark, con):
    events = defaultdict(list)
    for user, event, value in con.execute("SELECT user_id, event_id, value FROM events ORDER BY event_id").fetchall():
        events[user].append((event, value))
    want = {(user, e[k][0]): e[k][1] - e[k + 1][1] for user, e in events.items() for k in range(0, len(e) - 1, 2)}
    out = QUERIES["paired_margins"](spark, SMALL)
    got = {(r.user_id, r.event_id): r.margin for r in out.collect()}
    assert len({user for user, _ in want}) > 1 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    same(out.where("user_id = 8").drop("user_id"), con, """WITH l AS (SELECT event_id, value, lead(value) OVER (ORDER BY event_id) AS nxt, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE user_id = 8) SELECT event_id, round(value - nxt, 6) AS margin FROM l WHERE k % 2 = 1 AND nxt IS NOT NULL""")


def test_text_queries_of_all_languages(spark, con, tmp_path):
    texts = ["Le Café Noir, Été AB-12", "Ärger über den Weg; ABC-7é und XÉ-3\nÜber", None, "Señor El Niño Dos Tres", ""]
    rows = [(k, t, lang) for k, (t, lang) in enumerate(zip(texts, ["fr", "de", "en", None, "es"], strict=True))] + [(9, "Kind " * 20, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    titles = lambda t: len({x.lower() for x in re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b", t) if len(x) > 3})
    tickets = lambda t: len(set(re.findall(r"\b[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}\b", t)))
    for at, docs in ((str(tmp_path), [r[:2] for r in rows]), (SMALL, con.execute("SELECT doc_id, text FROM documents").fetchall())):
        got = {r.doc_id: (r.titles, r.tickets) for r in QUERIES["text_extractors"](spark, at).collect()}
        assert got == {i: (None, None) if t is None else (titles(t), tickets(t)) for i, t in docs}
        spans = {r.doc_id: r.spans for r in QUERIES["text_candidate_spans"](spark, at).collect()}
        pieces = lambda t: [re.sub(r"^[\s*\-0-9.)]+", "", x).strip(" ") for x in re.split("[,;\n]", t)]
        assert spans == {i: None if t is None else sum(x != "" and len(re.split(r"\s+", x)) <= 4 for x in pieces(t)) for i, t in docs}
        kinds = Counter(x for _, t in docs for x in re.findall(r"\b[A-Z][a-z]{2,}\b", t or ""))
        assert {r.kind: r.n for r in QUERIES["schema_mining"](spark, at).collect()} == {k: n for k, n in kinds.items() if n >= 20}
    english = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en'").select("doc_id")
    same(QUERIES["text_candidate_spans"](spark, SMALL).join(english, "doc_id"), con, r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '[;\n]', ',', 'g'), ','), lambda x: trim(regexp_replace(x, '^[\s*\-0-9.)]+', ''))), lambda x: x <> '' AND len(regexp_split_to_array(x, '\s+')) <= 4)) AS spans FROM documents WHERE lang = 'en'""")


def test_searches_of_all_turns(spark, con):
    tokens = lambda t: re.findall("[a-z0-9]+", (t or "").lower())

    def vector(t):
        n = Counter(sum(map(ord, w)) % 8 for w in tokens(t))
        length = math.sqrt(sum(x * x for x in n.values())) or 1.0
        return [n[k] / length for k in range(8)]

    turns = [((c, k), set(tokens(t)), vector(t)) for c, k, t in con.execute("SELECT conv_id, turn, text FROM conversations").fetchall()]
    overlap, best = {}, {}
    for item, text in con.execute("SELECT item_id, text FROM benchmark").fetchall():
        words, v = set(tokens(text)), vector(text)
        shares = {place: len(words & w) / len(words) if words else 0.0 for place, w, _ in turns}
        overlap |= {(item, *place): x for place, x in shares.items() if x}
        scores = {place: 0.65 * sum(a * b for a, b in zip(v, u, strict=True)) + 0.35 * shares[place] for place, _, u in turns}
        best[item] = sorted((-round(x, 9), place) for place, x in scores.items() if x > 0)[:5]
    out = QUERIES["text_token_overlap"](spark, SMALL)
    got = {(r.item_id, r.conv_id, r.turn): r.overlap for r in out.collect()}
    assert any(turn for *_, turn in got) and got.keys() == overlap.keys() and all(abs(got[k] - overlap[k]) < 1e-5 for k in got)
    token = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
    same(out.where("turn = 0").drop("turn"), con, f"""WITH q AS (SELECT item_id, {token} AS q FROM benchmark), d AS (SELECT conv_id, turn, {token} AS d FROM conversations WHERE turn = 0)
SELECT item_id, conv_id, round(len(list_intersect(q, d)) / len(q)::DOUBLE, 6) AS overlap FROM q, d WHERE len(list_intersect(q, d)) > 0""")
    found = defaultdict(list)
    for r in QUERIES["legacy_search"](spark, SMALL).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, (r.conv_id, r.turn)))
    for item, want in best.items():
        assert len(found[item]) == len(want) and all(abs(x + y) < 1e-8 for (x, _), (y, _) in zip(found[item], want, strict=True))
    assert any(turn for f in found.values() for _, (_, turn) in f)

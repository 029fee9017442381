"""False variants, degraded names and resampling against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import perturb as p
from lodegraph.operators import stats as s

FACTS = [
    (1, "Paris has 2 rivers and is older than Berlin by 12.5 years"),
    (2, "the Seine was 775 km long when Lutetia stood there"),
    (3, "nothing to change here"),
    (4, "Zanzibar alone"),
    (5, "London can wait"),
    (6, "London will not wait for the 3 ships of Paris to come home"),
    (7, ""),
    (8, None),
    (9, "12345678901234567890 is too long a number, 2 isn't"),
]


def draw(i, salt):
    return int(hashlib.md5(f"{i}{salt}".encode()).hexdigest()[:8], 16)


def test_variants(spark):
    rows = {r.fact_id: r for r in p.variants(spark.createDataFrame(FACTS, "fact_id long, text string")).collect()}
    names = {i: [n for n in re.findall(r"\b[A-Z][a-zA-Z]{3,}\b", t or "")] for i, t in FACTS}
    assert len(rows) == len(FACTS)
    for i, t in FACTS:
        r = rows[i]
        nums = [x for x in re.findall(r"\b\d+(?:\.\d+)?\b", t or "") if len(x) <= p.DIGITS]
        if nums:
            x = nums[draw(i, "number") % len(nums)]
            v = float(x)
            assert r["numeric"] == t.replace(x, str(int(v * 5) + 7) if v == int(v) else f"{v * 5 + 7:.1f}", 1)
        else:
            assert r["numeric"] is None
        said = next((t.replace(a, b, 1) for a, b in p.NEGATABLE if a in t), None) if t else None
        assert r.negation == said
        if names[i]:
            old = names[i][draw(i, "name") % len(names[i])]
            pool = {n for j, own in names.items() if j != i for n in own} - {old}
            assert r.entity in {t.replace(old, n, 1) for n in pool}
        else:
            assert r.entity is None
        if r.swap is not None:
            heads = " ".join(t.split()[: len(t.split()) // 2])
            assert r.swap.startswith(heads) and any(r.swap == f"{heads} {' '.join(o.split()[len(o.split()) // 2 :])}" for j, o in FACTS if j != i and o and len(o.split()) > 6)
        kinds = [k for k in p.KINDS if r[k] is not None]
        assert (r.kind, r.variant) == ((min(kinds, key=lambda k: draw(i, k)), r[min(kinds, key=lambda k: draw(i, k))]) if kinds else (None, None))
    assert rows[3].kind is None and rows[7].kind is None and rows[8].kind is None


@pytest.mark.parametrize("texts", [["Alpha beta"], ["Alpha", "Alpha"], ["Alpha Bravo", "none"], ["Alpha Bravo Coral", "Delta", "Bravo Elder"]])
def test_a_replacement_comes_from_another_fact(spark, texts):
    """Every draw is tried: the names that a fact gets are all that others have, and no others."""
    names = [re.findall(r"[A-Z][a-z]{3,}", t) for t in texts]
    facts = [(k * 100 + i, t) for i, t in enumerate(texts) for k in [0]]
    got = {r.fact_id: r.entity for r in p.entities(spark.createDataFrame(facts, "fact_id long, text string")).collect()}
    for i, t in facts:
        others = {n for j, own in enumerate(names) if j != i for n in own}
        possible = {t.replace(old, n, 1) for old in names[i] for n in others - {old}}
        assert got.get(i) in possible if i in got else not all(others - {old} for old in names[i]) or not names[i]


def test_degraded_and_renamed(spark):
    words = ["", "a", "abc", "abcd", "Gene Kelly", "Jean Luc  Picard", "x" * 20]
    table = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
    seed = F.col("i").cast("string")
    rows = {r.i: r for r in table.select("i", *[p.degraded(F.col("w"), k, seed).alias(k) for k in p.DEGRADED], *[p.renamed(F.col("w"), k).alias(k) for k in ("surname", "initials")]).collect()}
    for i, w in enumerate(words):
        n, at = len(w), {k: draw(i, k) % max(len(w) - end - 1, 1) + 1 for k, end in (("char_swap", 2), ("char_drop", 1), ("char_double", 1))}
        a, b, c = at["char_swap"], at["char_drop"], at["char_double"]
        assert rows[i].exact == w and rows[i].lowercase == w.lower() and rows[i].truncated == w[: max(4, int(n * 0.75))]
        assert rows[i].char_swap == (w if n < 4 else w[:a] + w[a + 1] + w[a] + w[a + 2 :])
        assert rows[i].char_drop == (w if n < 4 else w[:b] + w[b + 1 :])
        assert rows[i].char_double == (w if n < 3 else w[:c] + w[c] + w[c:])
    assert (rows[4].surname, rows[4].initials, rows[5].initials, rows[2].surname) == ("Kelly", "G. Kelly", "J. L. Picard", "abc")


def test_resampled_means_follow_the_binomial_law(spark, monkeypatch):
    """Over several blocks: mean and spread of the resamples' means are those of the sample, and the same call gives the same interval."""
    values = [float(i % 7) for i in range(700)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for block in (250_000, 150):
        monkeypatch.setattr(s, "BLOCK", block)
        means = np.array([r.m for r in s.resampled_means(table, "v", 4000, 3).orderBy("b").collect()])
        assert abs(means.mean() - 3.0) < 0.01 and abs(means.std() - 2.0 / np.sqrt(700)) < 0.004
        assert (means == np.array([r.m for r in s.resampled_means(table.repartition(3), "v", 4000, 3).orderBy("b").collect()])).all()
    one = s.bootstrap_mean(table, "v").first()
    assert one.low < one["mean"] == 3.0 < one.high and one.n == 700
    assert tuple(s.bootstrap_mean(table.limit(0), "v").first()) == (0.0, 0.0, 0.0, 0)
    same = s.bootstrap(spark.createDataFrame([(2.0,)] * 5, "d double"), "d", 100).first()
    assert tuple(same) == (2.0, 2.0, 2.0, 5, True)

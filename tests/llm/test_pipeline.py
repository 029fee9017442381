"""The corpus pipeline on the fixture: each stage's decisions take effect, clean documents stay."""

import numpy as np
import pytest

import corpus_pipeline as p
from tests.compare import same, views
from tests.conftest import SMALL
from tests.llm import fixture as fx


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = fx.documents()
    leak = docs[0][1] + "\nwhich was item one of the held out questions that nobody should have seen before the test"
    rows = [*docs, (500, leak, "en", "a", len(leak))]
    spark.createDataFrame(rows, fx.SCHEMA).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, "Which was item one of the held out questions that nobody should have seen before"), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_in_turn(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == p.COLUMNS, name
        assert stage(spark, docs.limit(0), folder).count() == 0
        path = f"{folder}/stage{k}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert ids(docs) <= ids(before)
        if name == "near dedup":
            found = fx.components([(r.doc_id, r.text) for r in before.collect()], p.SHINGLE, p.PERCENT)
            assert ids(docs) - {None} == {i for i, least in found.items() if i == least}
    left = ids(docs)
    assert 500 not in left and {3, 4, 6, 7, 8} <= left
    assert not left & {21, 22, 23, 24, 25, 27, 28}
    assert 14 in left and 15 not in left
    last = p.STAGES[-1][1](spark, docs, folder).collect()
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in last)


def test_run_is_the_stages(spark, folder):
    assert p.run(spark, folder).count() > 5


def test_operators_equal_their_sql(spark):
    from lodegraph.llm.queries import ORACLES, QUERIES

    con = views(SMALL)
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, SMALL), con, sql)

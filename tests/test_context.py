"""Contexts, bridges and join paths on small inputs."""

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import context as x
from lodegraph.operators import similarity


def test_join_path_in_either_direction():
    keys = {("a", "b"): ("a_b", "b_k"), ("c", "b"): ("c_b", "b_k")}
    assert x.join_path_sql(["a", "b", "c"], keys, "*").splitlines()[2:] == ["JOIN b ON a_b = b_k", "JOIN c ON b_k = c_b"]
    with pytest.raises(ValueError, match="no foreign key"):
        x.join_path_sql(["a", "c"], keys, "*")


def test_bridge_is_the_middle(spark):
    got = spark.range(1).select(x.bridge(F.array(*map(F.lit, "abc"))).alias("m"), x.bridge(F.array(F.lit("a"), F.lit("b"))).alias("n")).first()
    assert (got.m, got.n) == ("b", None)


def test_closest_names(spark):
    names = spark.createDataFrame([(1, "Aspirin  tablet"), (1, "Ibuprofen")], "k int, name string")
    golds = spark.createDataFrame([(1, "aspirin tablet"), (1, "ibuprofin"), (1, "zinc"), (2, "zinc")], "k int, gold string")
    got = {(r.k, r.gold): r.verdict for r in similarity.closest(names, golds, "k").collect()}
    assert got == {(1, "aspirin tablet"): "HIT", (1, "ibuprofin"): "NEAR", (1, "zinc"): "MISS", (2, "zinc"): "MISS"}

"""Embedding against a plain computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import embedding as E


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(0)
    tokens = [(s, i, rng.normal(size=4).tolist()) for s in ("a", "b") for i in range(6)]
    gate = [(s, rng.normal(size=4).tolist()) for s in ("a", "b")]
    norms = [
        (s, p, float(rng.normal()), float(1 + p), float(rng.normal()), float(rng.normal()))
        for s in ("a", "b") for p in range(5)
    ]
    return E.Model(
        spark.createDataFrame(tokens, "scope string, id int, vec array<double>"),
        spark.createDataFrame(gate, "scope string, w array<double>"),
        spark.createDataFrame(
            norms, "scope string, position int, mean double, var double, gamma double, beta double"
        ),
    )


@pytest.fixture(scope="module")
def sequences(spark):
    rows = [(1, "a", [1, 2, 3, 0, 0]), (2, "b", [5, 5, 4, 1, 2]), (3, "a", [0] * 5), (4, "zz", [1] * 5)]
    return spark.createDataFrame(rows, "k long, scope string, ids array<int>")


def plain(model, sequences):
    tokens = {(r.scope, r.id): np.array(r.vec) for r in model.tokens.collect()}
    gate = {r.scope: np.array(r.w) for r in model.gate.collect()}
    norms = {(r.scope, r.position): r for r in model.norms.collect()}
    out = {}
    for row in sequences.collect():
        if row.scope not in gate:
            continue
        total, mass = np.zeros(4), 0.0
        for p, i in enumerate(row.ids):
            if i:
                vec, n = tokens[row.scope, i], norms[row.scope, p]
                score = (vec @ gate[row.scope] - n["mean"]) / math.sqrt(n["var"] + 1e-5)
                weight = 1 / (1 + math.exp(-(score * n["gamma"] + n["beta"])))
                total, mass = total + weight * vec, mass + weight
        out[row.k] = total / (mass + 1e-8)
    return out


@pytest.mark.parametrize("group_rows", [1, 2, 1000])
def test_equals_plain_computation(spark, model, sequences, group_rows):
    known = sequences.where("scope <> 'zz'")
    expected = plain(model, known)
    found = {r.k: np.array(r.embedding) for r in E.embed(known, ["k"], model, group_rows=group_rows).collect()}
    assert set(found) == set(expected) == {1, 2, 3}
    for k in expected:
        np.testing.assert_allclose(found[k], expected[k], atol=1e-12)


def test_a_vector_does_not_move_for_each_occurrence(spark, model):
    """A thousand sequences of one scope get its parameters once a group."""
    rows = [(i, "a", [1 + i % 5] * 5) for i in range(1000)]
    many = spark.createDataFrame(rows, "k long, scope string, ids array<int>")
    found = E.embed(many, ["k"], model, group_rows=500)
    assert found.count() == 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate posexplode" not in plan


def test_only_vectors_of_occurring_tokens_move_and_small_groups_share_them(spark, model, monkeypatch):
    seen = {}
    real = E.with_parameters

    def watched(rows, keys, parameters, run, schema, group_rows):
        seen.update(tokens=parameters.where("id is not null").collect(), group_rows=group_rows)
        return real(rows, keys, parameters, run, schema, group_rows)

    monkeypatch.setattr(E, "with_parameters", watched)
    rows = spark.createDataFrame([(i, "a", [3] * 5) for i in range(20)], "k long, scope string, ids array<int>")
    found = E.embed(rows, ["k"], model, group_rows=2).collect()
    assert {(r.scope, r.id) for r in seen["tokens"]} == {("a", 0), ("a", 3), ("b", 0)}
    assert seen["group_rows"] == E.GROUP_ROWS and len(found) == 20
    expected = plain(model, rows)
    for row in found:
        np.testing.assert_allclose(row.embedding, expected[row.k], atol=1e-12)


def test_ids_that_the_model_does_not_have_weigh_nothing(spark, model):
    rows = spark.createDataFrame([(1, "a", [77] * 5)], "k long, scope string, ids array<int>")
    assert E.embed(rows, ["k"], model).first().embedding == [0.0] * 4


def test_unknown_and_incomplete_scopes_and_long_ids_are_errors(spark, model, sequences):
    with pytest.raises(Exception, match="no scope zz"):
        E.embed(sequences, ["k"], model).collect()
    for part in ("tokens", "gate", "norms"):
        lacking = model._replace(**{part: getattr(model, part).filter("scope = 'a'")})
        with pytest.raises(ValueError, match="incomplete.*'b'"):
            E.embed(sequences, ["k"], lacking)
    long = spark.createDataFrame([(1, "a", [1] * 6)], "k long, scope string, ids array<int>")
    with pytest.raises(Exception, match="norms"):
        E.embed(long, ["k"], model).collect()


def test_no_sequences(spark, model, sequences):
    assert E.embed(sequences.where("k = 99"), ["k"], model).count() == 0


def test_transfer_and_warm_start(spark, model):
    merged = spark.createDataFrame(
        [("a", "word", "x", 0, 1, 3), ("a", "word", "y", 1, 1, None)],
        "scope string, kind string, token string, id int, count long, base_id int",
    )
    rows = {r.id: r for r in E.transfer_embeddings(merged, model.tokens, 4).collect()}
    base = model.tokens.filter("scope = 'a' and id = 3").first().vec
    assert rows[0].copied and rows[0].vec == base
    assert not rows[1].copied and len(rows[1].vec) == 4
    again = E.transfer_embeddings(merged, model.tokens, 4).filter("id = 1").first()
    assert again.vec == rows[1].vec
    warm = E.warm_start(model, merged, 4, {"code": 5, "query": 3})
    assert warm.norms.count() == 5 and warm.gate.count() == 1


def test_random_vectors_look_normal(spark):
    vectors = spark.range(2000).select(
        E.random_vector(F.lit("s"), F.col("id").cast("string"), 8).alias("v")
    )
    values = np.array([r.v for r in vectors.collect()]).ravel()
    assert abs(values.mean()) < 0.05 and abs(values.std() - 1) < 0.05

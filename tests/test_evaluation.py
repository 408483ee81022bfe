"""Worked ranking scores."""

import math

import numpy as np
import pytest

from quarry.operators import evaluation as E, training as K


def test_ranks_count_ties_against_the_query(spark):
    # Unit vectors whose cosine distances are close to the worked matrix:
    # own distance tied in row two, beaten once in row three.
    code = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    query = [[1.0, 0.2], [1.0, 0.0], [0.6, 0.5]]
    rows = [("s", i, q, c) for i, (q, c) in enumerate(zip(query, code))]
    df = spark.createDataFrame(rows, "b string, k int, query_vec array<double>, code_vec array<double>")
    found = {r.k: r["rank"] for r in E.correct_ranks(df, ["b"], "k").collect()}
    assert found == {0: 2, 1: 2, 2: 3}


def test_zero_vectors_have_no_rank(spark):
    rows = [("s", 0, [0.0, 0.0], [1.0, 0.0]), ("s", 1, [1.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "b string, k int, query_vec array<double>, code_vec array<double>")
    assert [r.k for r in E.correct_ranks(df, ["b"], "k").collect()] == [1]


def test_overall_mrr_is_over_batches(spark):
    rng = np.random.default_rng(0)
    rows = [
        ("big" if i < 60 else "small", i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist())
        for i in range(85)
    ]
    df = spark.createDataFrame(rows, "language string, k int, query_vec array<double>, code_vec array<double>")
    per = {r.language: (r.mrr, r.n_batches) for r in E.mrr_by_language(df, "k", 20).collect()}
    overall = E.mrr(df, "k", 20).first()
    assert per["big"][1] == 3 and per["small"][1] == 1 and overall.n_batches == 4
    assert overall.mrr == pytest.approx((3 * per["big"][0] + per["small"][0]) / 4)
    assert "small" not in {r.language for r in E.mrr_by_language(df, "k", 30).collect()}


def test_ndcg_worked_case(spark):
    relevance = spark.createDataFrame(
        [("go", "q", "a", 3.0), ("go", "q", "b", 1.0), ("go", "q", "c", 0.0), ("go", "none", "a", 0.0),
         ("go", "missed", "z", 1.0)],
        "language string, query string, url string, relevance double",
    )
    predictions = spark.createDataFrame(
        [("go", "q", "b", 1), ("go", "q", "x", 2), ("go", "q", "a", 3)],
        "language string, query string, url string, rank int",
    )
    dcg = {r.query: r.dcg for r in E.gains(predictions, relevance).collect()}
    idcg = {r.query: r.idcg for r in E.ideal_gains(relevance).collect()}
    assert dcg["q"] == pytest.approx(4.5) and idcg["q"] == pytest.approx(7.630930, abs=1e-6)
    scores = {r.query: r.ndcg for r in E.ndcg_by_query(predictions, relevance).collect()}
    assert set(scores) == {"q", "missed"} and scores["missed"] == 0
    assert scores["q"] == pytest.approx(0.589705, abs=1e-6)
    row = E.ndcg_by_language(predictions, relevance).first()
    assert row.ndcg == pytest.approx(0.589705 / 2, abs=1e-6) and row.n_queries == 2
    assert E.mean_ndcg(predictions, relevance).first()[0] == pytest.approx(row.ndcg)
    assert E.url_lists(predictions).first().urls == ["b", "x", "a"]


def test_margin_loss_worked_case(spark):
    # Unit vectors that give the similarities [[.9, .5], [-.2, .3]].
    side = math.sqrt(0.75)
    code = [[1.0, 0.0, 0.0], [0.5, side, 0.0]]
    query = []
    for own, other in ((0.9, 0.5), (-0.2, 0.3)):
        y = (other - own * 0.5) / side
        query.append([own, y, math.sqrt(1 - own * own - y * y)])
    rows = [(0, i, query[i], code[i]) for i in range(2)]
    df = spark.createDataFrame(rows, "b int, k int, query_vec array<double>, code_vec array<double>")
    found = {r.k: r.loss for r in K.margin_losses(df, ["b"], "k").collect()}
    assert found == {0: pytest.approx(0.6, abs=1e-6), 1: pytest.approx(0.7, abs=1e-6)}
    assert K.mean_loss(df, ["b"], "k").first()[0] == pytest.approx(0.65, abs=1e-6)

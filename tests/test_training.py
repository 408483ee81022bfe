"""Gradients, early stopping and a short fit."""

from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import training as K
from quarry.operators.embedding import initial_model


def stops(spark, scores, patience=2):
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "run string, epoch int, score double")
    return K.early_stopping(df, ["run"], patience).first()


def test_early_stopping_worked_case(spark):
    row = stops(spark, [0.1, 0.3, 0.2, 0.25, 0.3, 0.1])
    assert (row.best_epoch, row.last_epoch, row.stopped) == (1, 3, True)


def test_equal_scores_renew_the_best_and_nan_is_a_miss(spark):
    row = stops(spark, [0.3, 0.2, 0.3, 0.1, 0.3])
    assert (row.best_epoch, row.last_epoch, row.stopped) == (4, 4, False)
    row = stops(spark, [0.3, float("nan"), float("nan"), 0.9])
    assert (row.best_epoch, row.last_epoch, row.stopped) == (0, 2, True)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    n, length, width = 5, 4, 3
    ids = {s: rng.integers(0, 6, size=(n, length)) for s in "qc"}
    part = {}
    for s in "qc":
        ids[s][:, 0] = 1 + np.arange(n) % 5
        part[s] = {
            "vec": rng.normal(size=(6, width)),
            "gate": rng.normal(size=width),
            "gamma": rng.normal(size=length + 1),
            "beta": rng.normal(size=length + 1),
            "mean": rng.normal(size=length + 1),
            "var": rng.uniform(0.5, 2, size=length + 1),
        }

    def forward():
        return {s: K._forward(ids[s], part[s]["vec"][ids[s]], part[s]) for s in "qc"}

    def loss():
        out = forward()
        return K._loss_gradient(out["q"]["mean"], out["c"]["mean"])[0]

    out = forward()
    _, *upstream = K._loss_gradient(out["q"]["mean"], out["c"]["mean"])
    for s, grad_mean in zip("qc", upstream):
        grad_vec, grads = K._backward(grad_mean, out[s], part[s]["vec"][ids[s]], part[s])
        summed = np.zeros_like(part[s]["vec"])
        np.add.at(summed, ids[s].reshape(-1), grad_vec.reshape(-1, width))
        for kind, grad in {"vec": summed, **grads}.items():
            target = part[s][kind]
            for place in np.ndindex(target.shape):
                old, step = target[place], 1e-6
                target[place] = old + step
                up = loss()
                target[place] = old - step
                down = loss()
                target[place] = old
                if kind != "vec" or place[0] != 0:
                    assert grad[place] == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_fit_improves(spark):
    """Queries repeat their code's tokens, so there is something to learn."""
    n = 120
    token = lambda salt: 2 + F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(18)).cast("int")
    ids = F.array(*[token(s) for s in range(3)], F.lit(0))
    sequences = spark.range(n).select(
        F.col("id").alias("row_id"), F.lit("python").alias("language"),
        ids.alias("code_ids"), ids.alias("query_ids"),
    )
    vocabulary = spark.createDataFrame(
        [(s, "word", f"t{i}", i, 1) for s in ("python", "query") for i in range(20)],
        "scope string, kind string, token string, id int, count long",
    )
    model = initial_model(vocabulary, 8, {"code": 4, "query": 4})
    best, history = K.fit(
        sequences, sequences, model, batch_size=40, rate=0.1, max_epochs=4, patience=3,
        evaluation_batch=40, batches_per_step=1,
    )
    rows = history.orderBy("epoch").collect()
    assert rows[-1].loss < rows[0].loss and max(r.score for r in rows) > 0.3
    norms = best.norms.filter("scope = 'query'").collect()
    assert len(norms) == 4 and any(r["mean"] != 0.0 for r in norms) and any(r.beta != 0.0 for r in norms)
    assert best.tokens.filter("scope = 'python' and id = 0").first().vec == [0.0] * 8


def test_a_step_reads_its_own_batches(spark, monkeypatch):
    ids = F.array(*[2 + F.pmod(F.xxhash64("id", F.lit(s)), F.lit(18)).cast("int") for s in range(3)])
    sequences = spark.range(100).select(
        F.col("id").alias("row_id"), F.lit("python").alias("language"), ids.alias("code_ids"), ids.alias("query_ids")
    )
    vocabulary = spark.createDataFrame(
        [(s, "word", f"t{i}", i, 1) for s in ("python", "query") for i in range(20)],
        "scope string, kind string, token string, id int, count long",
    )
    plans, plain = [], K.gradients

    def seen(batch, *rest):
        plans.append((batch._jdf.queryExecution().executedPlan().toString(), batch.count()))
        return plain(batch, *rest)

    monkeypatch.setattr(K, "gradients", seen)
    K.fit(
        sequences, sequences, initial_model(vocabulary, 4, {"code": 3, "query": 3}), batch_size=10, max_epochs=1,
        evaluation_batch=50, batches_per_step=4,
    )
    assert [n for _, n in plans] == [40, 40, 20]
    assert all("PartitionFilters: [isnotnull(_step" in plan for plan, _ in plans)


def pairs_of(spark, n, owner=""):
    ids = F.array(*[2 + F.pmod(F.xxhash64("id", F.lit(s)), F.lit(18)).cast("int") for s in range(3)])
    return spark.range(n).select(
        F.concat_ws(":", F.lit(owner), "id").alias("row_id"), F.lit("python").alias("language"),
        F.lit(owner).alias("owner"), ids.alias("code_ids"), F.reverse(ids).alias("query_ids"),
    )


def model_of(spark, *owners):
    scopes = [f"{owner}/{name}".lstrip("/") for owner in owners for name in ("python", "query")]
    vocabulary = spark.createDataFrame(
        [(s, "word", f"t{i}", i, 1) for s in scopes for i in range(20)],
        "scope string, kind string, token string, id int, count long",
    )
    return initial_model(vocabulary, 4, {"code": 3, "query": 3})


def test_parameters_are_written_once_for_many_steps(spark, monkeypatch):
    names, plain = [], K.materialise
    monkeypatch.setattr(K, "materialise", lambda df, name="table", by=None: names.append(name) or plain(df, name, by))
    sequences = pairs_of(spark, 100)
    K.fit(
        sequences, sequences, model_of(spark, ""), batch_size=5, max_epochs=1, evaluation_batch=50, batches_per_step=1
    )
    # 20 steps: the first parameters, those after 16 steps and the last ones.
    assert names.count("weights") == 3 and "gradients" not in names


def test_owners_train_as_if_alone(spark):
    """One owner has three steps and the other one, after which it stays as it is."""
    options = dict(batch_size=10, rate=0.1, max_epochs=1, evaluation_batch=5, batches_per_step=1)
    a, b = pairs_of(spark, 30, "a"), pairs_of(spark, 10, "b")
    both = a.unionByName(b)
    model, history = K.fit(both, both, model_of(spark, "a", "b"), **options)
    found = {(r.owner, r.epoch): (r.loss, r.score) for r in history.collect()}
    vectors = {(r.scope, r.id): r.vec for r in model.tokens.collect()}
    for owner, sequences in (("a", a), ("b", b)):
        alone, own = K.fit(sequences, sequences, model_of(spark, owner), **options)
        for r in own.collect():
            assert found.pop((owner, r.epoch)) == pytest.approx((r.loss, r.score), abs=1e-12)
        for r in alone.tokens.collect():
            assert vectors.pop((r.scope, r.id)) == pytest.approx(r.vec, abs=1e-12)
    assert not found and not vectors


def test_a_step_matches_plain_sums():
    rng = np.random.default_rng(3)
    width, length, rate = 3, 4, 0.1
    order = {"python": np.array([5, 0, 2, 1, 4, 3], np.int32), "query": np.arange(6, dtype=np.int32)}
    state = {}
    for scope, ids in order.items():
        state[scope] = {"token": {"ids": ids, "vec": rng.normal(size=(6, width))}}
        for kind in K._SCOPE_KINDS:
            vec = rng.uniform(0.5, 2, size=width if kind == "gate" else length)
            state[scope][kind] = {"ids": np.zeros(1, np.int32), "vec": vec}
        for part in state[scope].values():
            part |= {name: rng.uniform(0, 0.1, size=part["vec"].shape) for name in "mv"}
    ids = {s: rng.integers(0, 6, size=(5, length)) for s in order}
    numbers = np.array([1, 0, 1, 0, 1])
    batches = pa.table({
        "batch_id": pa.array(numbers, pa.int32()), "row_id": pa.array(range(5)),
        "code_scope": ["python"] * 5, "query_scope": ["query"] * 5,
        "code_ids": pa.array(ids["python"].tolist(), pa.list_(pa.int32())),
        "query_ids": pa.array(ids["query"].tolist(), pa.list_(pa.int32())),
    })
    moved = K._moved(batches, K._packed("", state, 6), partial(K.adam_step, rate=rate))
    found = K._state(moved)

    sums, losses = {}, 0.0
    for batch in (0, 1):
        part, out, vec, place = {}, {}, {}, {}
        for s in order:
            part[s] = {kind: own["vec"] for kind, own in state[s].items()}
            place[s] = np.argsort(order[s])[ids[s][numbers == batch]]
            vec[s] = part[s]["token"][place[s]]
            out[s] = K._forward(ids[s][numbers == batch], vec[s], part[s])
        loss, *upstream = K._loss_gradient(out["query"]["mean"], out["python"]["mean"])
        losses += loss
        for s, grad_mean in zip(("query", "python"), upstream):
            grad_vec, grads = K._backward(grad_mean, out[s], vec[s], part[s])
            token = np.zeros((6, width))
            np.add.at(token, place[s].reshape(-1), grad_vec.reshape(-1, width))
            token[order[s] == 0] = 0.0
            for kind, grad in {"token": token, **grads, **K._statistics(out[s], part[s])}.items():
                sums[s, kind] = sums.get((s, kind), 0.0) + grad / 2
    for (s, kind), grad in sums.items():
        own = state[s][kind]
        if kind in ("mean", "var"):
            expected = 0.9 * own["vec"] + 0.1 * grad
        else:
            m, v = 0.9 * own["m"] + 0.1 * grad, 0.999 * own["v"] + 0.001 * grad * grad
            expected = own["vec"] - rate * (m / (1 - 0.9**7)) / (np.sqrt(v / (1 - 0.999**7)) + 1e-8)
        if kind == "token":
            expected = expected[np.argsort(order[s])]
        assert found[s][kind]["vec"] == pytest.approx(expected, abs=1e-12)
    assert found[None]["loss"]["vec"] == pytest.approx([losses, 2])
    assert set(moved.column("t").to_pylist()) == {7}

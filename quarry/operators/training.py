"""Fitting the encoders: batch losses, parameter updates, early stopping."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry import constants as C
from quarry.operators.embedding import Model, embed, list_column, matrix
from quarry.operators.evaluation import mrr
from quarry.operators.ranking import proportional_batches
from quarry.session import materialise

#: Steps of a job, and ids of a parameter row that are taken at once.
STEPS_AT_ONCE, SLICE = 16, 1 << 12


def _guarded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / (length + C.NORM_EPSILON), length


def margin_losses(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    """Loss of every (query, code) pair against the other codes of its batch:
    one minus its own similarity plus the largest positive other one, not
    below zero."""
    selected = pairs.select(*by, key, "query_vec", "code_vec")
    schema = selected.drop("query_vec", "code_vec").withColumn("loss", F.lit(0.0)).schema

    def losses(table: pa.Table) -> pa.Table:
        query, _ = _guarded(matrix(table.column("query_vec")).astype(np.float64))
        code, _ = _guarded(matrix(table.column("code_vec")).astype(np.float64))
        similarity = query @ code.T
        own = np.diag(similarity).copy()
        np.fill_diagonal(similarity, 0.0)
        loss = np.maximum(1.0 - own + np.maximum(similarity.max(axis=1), 0.0), 0.0)
        columns = [table.column(name).combine_chunks() for name in [*by, key]]
        return pa.Table.from_arrays([*columns, pa.array(loss)], [*by, key, "loss"])

    return selected.groupBy(*by).applyInArrow(losses, schema)


def batch_losses(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    return margin_losses(pairs, by, key).groupBy(*by).agg(F.avg("loss").alias("loss"))


def mean_loss(pairs: DataFrame, by: list[str], key: str) -> DataFrame:
    return batch_losses(pairs, by, key).agg(F.avg("loss").alias("mean_loss"))


def early_stopping(
    scores: DataFrame, by: list[str], patience: int = C.PATIENCE
) -> DataFrame:
    """Best and last epoch of each run from its ``(epoch, score)`` rows.

    A score below the best so far is a miss; ``patience`` misses in a row end
    the run; an equal score counts as a new best. NaN is a miss. A run has at
    most the configured number of epochs, which bounds the windows.
    """
    run = Window.partitionBy(*by).orderBy("epoch")
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    score = F.when(~F.isnan("score"), F.col("score"))
    judged = scores.withColumn("_score", score).withColumn("_best", F.max("_score").over(earlier))
    miss = F.col("_score").isNull() | F.coalesce(F.col("_score") < F.col("_best"), F.lit(False))
    counted = (
        judged.withColumn("_miss", miss.cast("int"))
        .withColumn("_island", F.sum(1 - F.col("_miss")).over(upto))
        .withColumn(
            "misses",
            F.sum("_miss").over(
                Window.partitionBy(*by, "_island")
                .orderBy("epoch")
                .rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
    )
    stop = counted.withColumn(
        "_stops", F.sum((F.col("misses") >= patience).cast("int")).over(earlier)
    ).filter(F.coalesce(F.col("_stops"), F.lit(0)) == 0)
    return stop.groupBy(*by).agg(
        F.max(F.when(F.col("_miss") == 0, F.col("epoch"))).alias("best_epoch"),
        F.max("_score").alias("best_score"),
        F.max("epoch").alias("last_epoch"),
        (F.max("misses") >= patience).alias("stopped"),
    )


# --- Gradients --------------------------------------------------------------
# An owner's task receives the batches of a step and the owner's parameters.


def _forward(ids, vec, part: dict):
    """Means and what their gradient needs; ``vec`` rows follow ``ids``."""
    length = ids.shape[1]
    scale = 1.0 / np.sqrt(part["var"][:length] + C.BATCH_NORM_EPSILON)
    raw = vec @ part["gate"]
    normal = (raw - part["mean"][:length]) * scale
    weight = 1.0 / (1.0 + np.exp(-(normal * part["gamma"][:length] + part["beta"][:length])))
    weight = weight * (ids != 0)
    mass = weight.sum(axis=1, keepdims=True) + C.NORM_EPSILON
    mean = np.einsum("nl,nld->nd", weight, vec) / mass
    return {"mean": mean, "weight": weight, "mass": mass, "normal": normal, "raw": raw, "scale": scale}


def _backward(grad_mean, out: dict, vec, part: dict):
    """Gradients of the token vectors (per occurrence) and of the gate, scale
    and shift parameters; the running statistics count as constants."""
    weight, length = out["weight"], out["weight"].shape[1]
    along = (grad_mean * out["mean"]).sum(axis=1, keepdims=True)
    inner = (np.einsum("nd,nld->nl", grad_mean, vec) - along) / out["mass"]
    score = inner * weight * (1.0 - weight)
    raw = score * part["gamma"][:length] * out["scale"]
    grad_vec = (weight / out["mass"])[:, :, None] * grad_mean[:, None, :]
    grad_vec += raw[:, :, None] * part["gate"]

    def over_positions(values):
        whole = np.zeros(len(part["gamma"]))
        whole[:length] = values.sum(axis=0)
        return whole

    return grad_vec, {
        "gate": np.einsum("nl,nld->d", raw, vec),
        "gamma": over_positions(score * out["normal"]),
        "beta": over_positions(score),
    }


def _statistics(out: dict, part: dict) -> dict:
    """Mean and variance of the raw scores of a batch, per position."""
    raw, found = out["raw"], {}
    values = {"mean": raw.mean(axis=0), "var": raw.var(axis=0, ddof=1 if len(raw) > 1 else 0)}
    for kind, value in values.items():
        found[kind] = part[kind].copy()
        found[kind][: raw.shape[1]] = value
    return found


def _loss_gradient(query: np.ndarray, code: np.ndarray):
    """Mean margin loss of a batch and its gradients by both embeddings."""
    q, q_length = _guarded(query)
    c, c_length = _guarded(code)
    n = len(q)
    similarity = q @ c.T
    others = similarity.copy()
    np.fill_diagonal(others, -np.inf)
    rival = others.argmax(axis=1)
    rival_similarity = others[np.arange(n), rival]
    loss = 1.0 - np.diag(similarity) + np.maximum(rival_similarity, 0.0)
    live = (loss > 0) / n
    grad = np.zeros_like(similarity)
    grad[np.arange(n), np.arange(n)] -= live
    grad[np.arange(n), rival] += live * (rival_similarity > 0)

    def through_norm(grad_unit, unit, length):
        along = (grad_unit * unit).sum(axis=1, keepdims=True)
        safe = np.maximum(length, 1e-12)
        return (grad_unit - unit * along * (length + C.NORM_EPSILON) / safe) / (
            length + C.NORM_EPSILON
        )

    return (
        np.maximum(loss, 0.0).mean(),
        through_norm(grad @ c, q, q_length),
        through_norm(grad.T @ q, c, c_length),
    )


# Parameters travel as rows of many ids each: ``vec``, ``m`` and ``v`` hold the
# numbers of all ``ids`` one after the other. Kind ``loss`` has the sum of the
# losses of an owner's batches so far in ``vec``, and their number.
_PACKED_SCHEMA = (
    "owner string, kind string, scope string, ids array<int>, vec array<double>, m array<double>, "
    "v array<double>, t int"
)
_NUMBERS = ["vec", "m", "v"]


# Parameters with one row per scope; the last two are running statistics.
_SCOPE_KINDS = ["gate", "gamma", "beta", "mean", "var"]


def _state(parameters: pa.Table) -> dict:
    """Arrays of each scope and kind of an owner's parameters: ``ids`` in order
    and ``vec``, ``m`` and ``v``, of which token has a row for each id."""
    places: dict = {}
    for i, key in enumerate(zip(*(parameters.column(c).to_pylist() for c in ("scope", "kind")))):
        places.setdefault(key, []).append(i)
    state: dict = {}
    for (scope, kind), at in places.items():
        rows = parameters.slice(at[0], 1) if len(at) == 1 else parameters.take(pa.array(at))
        ids = rows.column("ids").combine_chunks().flatten().to_numpy()
        own = {name: rows.column(name).combine_chunks().flatten().to_numpy() for name in _NUMBERS}
        if kind == "token":
            own = {name: x.reshape(len(ids), -1) for name, x in own.items()}
            if (ids[1:] < ids[:-1]).any():
                order = np.argsort(ids, kind="stable")
                ids, own = ids[order], {name: x[order] for name, x in own.items()}
        state.setdefault(scope, {})[kind] = {"ids": ids, **own}
    return state


def _packed(owner: str | None, state: dict, t: int) -> pa.Table:
    rows = [(kind, scope, part) for scope, kinds in state.items() for kind, part in kinds.items()]

    def lists(name: str, type_: pa.DataType) -> pa.Array:
        flat = [part[name].reshape(-1) for _, _, part in rows]
        offsets = np.cumsum([0, *map(len, flat)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat), type_))

    columns = {
        "owner": pa.array([owner] * len(rows), pa.string()),
        "kind": pa.array([kind for kind, _, _ in rows], pa.string()),
        "scope": pa.array([scope for _, scope, _ in rows], pa.string()),
        "ids": lists("ids", pa.int32()),
        **{name: lists(name, pa.float64()) for name in _NUMBERS},
        "t": pa.array([t] * len(rows), pa.int32()),
    }
    return pa.table(columns)


def _batch_gradient(sequences: pa.Table, model: dict) -> tuple[float, list]:
    """Loss of a batch and, by scope and kind, gradients and statistics."""
    query_scope = sequences.column("query_scope")[0].as_py()
    code_scopes = np.array(sequences.column("code_scope").to_pylist(), dtype=object)
    code_ids = matrix(sequences.column("code_ids"))
    parts = [(query_scope, np.arange(len(code_scopes)), matrix(sequences.column("query_ids")))]
    parts += [
        (scope, np.flatnonzero(code_scopes == scope), code_ids)
        for scope in dict.fromkeys(code_scopes)
    ]
    state, width = [], len(model[query_scope]["gate"])
    embedded = {side: np.zeros((len(code_scopes), width)) for side in (True, False)}
    for scope, rows, all_ids in parts:
        part, own = model[scope], all_ids[rows]
        place = np.searchsorted(part["ids"], own)
        vec = part["vec"][place]
        out = _forward(own, vec, part)
        embedded[scope == query_scope][rows] = out["mean"]
        state.append((scope, rows, place, vec, out))
    loss, grad_query, grad_code = _loss_gradient(embedded[True], embedded[False])

    found = []
    for scope, rows, place, vec, out in state:
        part = model[scope]
        upstream = (grad_query if scope == query_scope else grad_code)[rows]
        grad_vec, shared = _backward(upstream, out, vec, part)
        place, grad_vec = place.reshape(-1), grad_vec.reshape(-1, width)
        summed = np.array([np.bincount(place, grad_vec[:, i], len(part["ids"])) for i in range(width)]).T
        summed[part["ids"] == 0] = 0.0
        found.append((scope, {"token": summed, **shared, **_statistics(out, part)}))
    return float(loss), found


def _moved(batches: pa.Table, parameters: pa.Table, move: Callable) -> pa.Table:
    """An owner's parameters after ``move`` by the gradients of its batches."""
    if not len(batches):
        return parameters
    state = _state(parameters)
    losses = state.pop(None, {}).pop("loss", None)
    model = {
        scope: {"ids": kinds["token"]["ids"], "vec": kinds["token"]["vec"]} | {kind: kinds[kind]["vec"] for kind in _SCOPE_KINDS}
        for scope, kinds in state.items()
    }
    batches = batches.sort_by([("batch_id", "ascending"), ("row_id", "ascending")])
    numbers = batches.column("batch_id").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
    sums, counts, loss = {}, Counter(), 0.0
    for first, end in zip(edges, edges[1:]):
        own, found = _batch_gradient(batches.slice(first, end - first), model)
        loss += own
        for scope, kinds in found:
            for kind, grad in kinds.items():
                key, counts[scope, kind] = (scope, kind), counts[scope, kind] + 1
                sums[key] = sums[key] + grad if key in sums else grad
    n, t = len(edges) - 1, parameters.column("t")[0].as_py() + 1
    state = move(state, sums, counts, n, t)
    so_far = np.zeros(2) if losses is None else losses["vec"]
    none = np.zeros(0)
    state[None] = {"loss": {"ids": np.zeros(0, np.int32), "vec": so_far + [loss, n], "m": none, "v": none}}
    return _packed(parameters.column("owner")[0].as_py(), state, t)


def gradients(batch: DataFrame, weights: DataFrame, move: Callable) -> DataFrame:
    """The packed parameters after ``move`` by the gradients and statistics of all
    given batches, one task per owner.

    ``batch`` has owner, batch_id, row_id, code_scope, query_scope, code_ids and
    query_ids; the batches of an owner are bounded by the batch size and their
    number in a step, its parameters by the sizes of its vocabularies. An
    owner's parameters move once, as a row for each scope and kind. Owners
    without a batch stay as they are.
    """

    def moved(batches: pa.Table, parameters: pa.Table) -> pa.Table:
        return _moved(batches, parameters, move)

    return (
        batch.groupBy("owner")
        .cogroup(weights.groupBy("owner"))
        .applyInArrow(moved, _PACKED_SCHEMA)
    )


def adam_step(
    state: dict,
    sums: dict,
    counts: dict,
    n: int,
    t: int,
    rate: float,
    decay1: float = 0.9,
    decay2: float = 0.999,
    epsilon: float = 1e-8,
    momentum: float = 0.1,
) -> dict:
    """Adam on the arrays of an owner; parameters without a gradient see a zero
    one. Running statistics move towards the batches' mean by ``momentum``.

    ``sums`` holds sums over the ``n`` batches of step ``t`` by scope and kind,
    ``counts`` how many batches had any.
    """
    stepped: dict = {}
    for scope, kinds in state.items():
        for kind, part in kinds.items():
            total = sums.get((scope, kind))
            own = dict(part)
            if kind in ("mean", "var"):
                if total is not None:
                    own["vec"] = (1 - momentum) * part["vec"] + momentum * (total / counts[scope, kind])
            else:
                grad = 0.0 if total is None else total / n
                own["m"] = decay1 * part["m"] + (1 - decay1) * grad
                own["v"] = decay2 * part["v"] + (1 - decay2) * grad * grad
                first, second = 1 - decay1**t, 1 - decay2**t
                own["vec"] = part["vec"] - rate * (own["m"] / first) / (np.sqrt(own["v"] / second) + epsilon)
            stepped.setdefault(scope, {})[kind] = own
    return stepped


def scope_name(owner, name):
    """Parameters of an owner's encoder; the base model has no owner."""
    return F.when(owner == "", name).otherwise(F.concat_ws("/", owner, name))


def owner_of(scope):
    """Everything before the last part of a scope name."""
    return F.regexp_extract(scope, r"^(?:(.*)/)?[^/]*$", 1)


def _weights(model: Model) -> DataFrame:
    """All parameters of a model in one table, ready for Adam: packed, each id in
    a row of its own."""
    tokens = model.tokens.select(F.lit("token").alias("kind"), "scope", "id", "vec")
    gate = model.gate.select(
        F.lit("gate").alias("kind"), "scope", F.lit(0).alias("id"), F.col("w").alias("vec")
    )
    kinds = ["gamma", "beta", "mean", "var"]
    placed = F.array_sort(F.collect_list(F.struct("position", *kinds)))
    arrays = model.norms.groupBy("scope").agg(placed.alias("placed"))
    rows = [
        F.struct(F.lit(kind).alias("kind"), F.col(f"placed.{kind}").alias("vec")) for kind in kinds
    ]
    norms = arrays.select("scope", F.inline(F.array(*rows))).select(
        "kind", "scope", F.lit(0).alias("id"), "vec"
    )
    zero = F.transform("vec", lambda _: F.lit(0.0))
    rows = tokens.unionByName(gate).unionByName(norms)
    vec = F.col("vec").cast("array<double>")
    return rows.select(
        owner_of(F.col("scope")).alias("owner"), "kind", "scope", F.array(F.col("id").cast("int")).alias("ids"),
        vec.alias("vec"), zero.alias("m"), zero.alias("v"), F.lit(0).alias("t"),
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each id of token rows, taken ``SLICE`` ids at a time."""
    for batch in batches:
        for scope, ids, vec in zip(batch.column("scope"), batch.column("ids"), batch.column("vec")):
            ids, vec = (x.values.to_numpy() for x in (ids, vec))
            vec = vec.reshape(len(ids), -1)
            for i in range(0, len(ids), SLICE):
                own = ids[i : i + SLICE]
                columns = [pa.array([scope.as_py()] * len(own), pa.string()), pa.array(own), list_column(vec[i : i + SLICE])]
                yield pa.RecordBatch.from_arrays(columns, ["scope", "id", "vec"])


def _model(weights: DataFrame) -> Model:
    def one(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("vec"))).alias(kind)

    arrays = (
        weights.filter(F.col("kind").isin("gamma", "beta", "mean", "var"))
        .groupBy("scope")
        .agg(*[one(kind) for kind in ("mean", "var", "gamma", "beta")])
    )
    zipped = F.posexplode(F.arrays_zip("mean", "var", "gamma", "beta")).alias("position", "x")
    norms = arrays.select("scope", zipped).select("scope", "position", "x.*")
    tokens = weights.filter("kind = 'token'").select("scope", "ids", "vec")
    return Model(
        materialise(tokens.mapInArrow(_unpacked, "scope string, id int, vec array<double>"), "tokens"),
        weights.filter("kind = 'gate'").select("scope", F.col("vec").alias("w")),
        norms,
    )


def _with_scopes(sequences: DataFrame) -> DataFrame:
    if "owner" not in sequences.columns:
        sequences = sequences.withColumn("owner", F.lit(""))
    owner = F.col("owner")
    return sequences.withColumns(
        {
            "code_scope": scope_name(owner, F.col("language")),
            "query_scope": scope_name(owner, F.lit("query")),
        }
    )


def embed_pairs(sequences: DataFrame, model: Model, key: str = "row_id") -> DataFrame:
    """Query and code embedding of each (query, code) pair of sequences."""
    sequences = _with_scopes(sequences)
    code = embed(
        sequences.withColumn("scope", F.col("code_scope")),
        [key, "owner", "language"], model, "code_vec", "code_ids",
    ).drop("scope")
    query = embed(
        sequences.withColumn("scope", F.col("query_scope")), [key], model, "query_vec", "query_ids"
    ).drop("scope")
    return code.join(query, key)


def fit(
    train: DataFrame,
    valid: DataFrame,
    model: Model,
    batch_size: int = C.DEFAULT_BATCH_SIZE,
    rate: float = C.LEARNING_RATE,
    max_epochs: int = C.MAX_EPOCHS,
    patience: int = C.PATIENCE,
    evaluation_batch: int = C.EVALUATION_BATCH,
    batches_per_step: int = 8,
    seed: int = 0,
) -> tuple[Model, DataFrame]:
    """Synchronous data-parallel training; returns the best model and the
    history ``(owner, epoch, loss, score)``.

    Sequences with an ``owner`` column train one model per owner, all in the
    same jobs: batches never mix owners, an owner's parameters see only its
    own batches, and it stops on its own validation score. Every step works
    on ``batches_per_step`` batches of each owner: one task per owner takes the
    gradients of its batches, sums them and moves its parameters. Steps follow
    each other without the driver, ``STEPS_AT_ONCE`` in a job, then the
    parameters are written. Batches are laid out by step, so a step reads its
    own only. Two numbers per epoch reach the driver.
    """
    train, valid = _with_scopes(train), _with_scopes(valid)
    weights = materialise(_weights(model), "weights")
    best = weights
    state = materialise(
        train.select("owner").distinct().select(
            "owner", F.lit(None).cast("double").alias("best_score"), F.lit(0).alias("misses")
        ),
        "state",
    )
    history = None
    for epoch in range(max_epochs):
        active = state.filter(F.col("misses") < patience).select("owner")
        batched = materialise(
            proportional_batches(
                train.join(active, "owner", "left_semi"),
                "language", "row_id", batch_size, seed + epoch, within=["owner"],
            ).select(
                "owner", "batch_id", "row_id", "code_scope", "query_scope", "code_ids", "query_ids",
                F.expr(f"batch_id div {batches_per_step}").cast("int").alias("_step"),
            ),
            "batches", ["_step"],
        )
        n_batches = batched.agg(F.max("batch_id")).first()[0]
        if n_batches is None:
            break
        move = partial(adam_step, rate=rate)
        steps = n_batches // batches_per_step + 1
        for step in range(steps):
            part = batched.filter(F.col("_step") == step).drop("_step")
            weights = gradients(part, weights, move)
            if (step + 1) % STEPS_AT_ONCE == 0 or step + 1 == steps:
                weights = materialise(weights, "weights")
        sums = weights.filter("kind = 'loss'")
        loss = sums.select("owner", (F.col("vec")[0] / F.col("vec")[1]).alias("loss"))
        weights = weights.filter("kind != 'loss'")
        pairs = embed_pairs(
            valid.join(active, "owner", "left_semi"), _model(weights)
        )
        scores = mrr(pairs, "row_id", evaluation_batch, 0, ["owner"])
        judged = materialise(
            loss.join(scores, "owner", "left").select(
                "owner", F.lit(epoch).alias("epoch"), "loss", F.col("mrr").alias("score")
            ),
            "judged",
        )
        history = judged if history is None else history.unionByName(judged)
        # Without a score so far the last epoch is the best one.
        better = F.col("best_score").isNull() | F.coalesce(
            F.col("score") >= F.col("best_score"), F.lit(False)
        )
        state = materialise(
            state.join(judged, "owner", "left").select(
                "owner",
                F.when(better, F.col("score")).otherwise(F.col("best_score")).alias("best_score"),
                F.when(F.col("epoch").isNull(), F.col("misses"))
                .when(better, 0)
                .otherwise(F.col("misses") + 1)
                .alias("misses"),
            ),
            "state",
        )
        improved = judged.join(state, "owner").filter(F.col("misses") == 0).select("owner")
        best = materialise(
            weights.join(improved, "owner", "left_semi").unionByName(
                best.join(improved, "owner", "left_anti")
            ),
            "best",
        )
    return _model(best), history

"""Attention-weighted mean embeddings of token id sequences.

Model parameters are tables: ``tokens(scope, id, vec)``, ``gate(scope, w)``
and ``norms(scope, position, mean, var, gamma, beta)``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quarry import constants as C
from quarry.functions import vectors as V
from quarry.operators.scopes import fields, take_columns, with_parameters
from quarry.session import materialise

#: Sequences, at least, that meet one copy of their scope's parameters, and those
#: whose vectors are gathered at once, at most.
GROUP_ROWS, SLICE_ROWS = 1 << 14, 512


class Model(NamedTuple):
    tokens: DataFrame
    gate: DataFrame
    norms: DataFrame


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column as a 2-d array; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def list_column(values: np.ndarray, type_: pa.DataType = pa.float64()) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), type=type_)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def token_gates(model: Model) -> DataFrame:
    """Each token vector with its inner product with the scope's gate.

    The product depends on the token only, so it is taken once per
    vocabulary entry instead of once per occurrence.
    """
    return model.tokens.join(model.gate, "scope").select(
        "scope", "id", "vec", V.dot(F.col("vec"), F.col("w")).alias("gate")
    )


def embed(
    sequences: DataFrame, keys: list[str], model: Model, name: str = "embedding", ids: str = "ids",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One embedding per sequence: ``keys, scope`` and ``name``.

    Sequences meet the parameters of their scope in salted groups, so a vector
    moves once for a group and not for each occurrence of its token, whatever
    the number of scopes. Sequences are taken ``group_rows`` at a time; smaller
    groups than ``GROUP_ROWS`` share one copy of the parameters, so copies stay
    few, and vectors of tokens that no sequence holds do not move. A scope that the model does not have, or of which it
    has only some of tokens, gate and norms, and ids longer than the scope's
    norms, are errors.
    """
    check_scopes(model)
    rows = materialise(sequences.select(*keys, "scope", F.col(ids).alias("_ids")), "sequences")
    held = token_gates(model._replace(tokens=used_tokens(model.tokens, rows)))
    parameters = held.unionByName(model.norms, allowMissingColumns=True)
    # Slices bound the gathered (rows, length, width) array.
    step = min(SLICE_ROWS, group_rows)

    def run(scope: str, group: pa.Table, own: pa.Table) -> pa.Table:
        if not len(own):
            raise ValueError(f"the model has no scope {scope}")
        part = _parameters(own)
        all_ids = matrix(group.column("_ids"))
        vectors = [mean_vectors(all_ids[i : i + step], part) for i in range(0, len(all_ids), step)]
        vectors = np.concatenate(vectors) if vectors else np.zeros((0, 1))
        return pa.table([*take_columns(group, [*keys, "scope"]), list_column(vectors)], [*keys, "scope", name])

    schema = f"{fields(rows, [*keys, 'scope'])}, `{name}` array<double>"
    return with_parameters(rows, keys, parameters, run, schema, max(group_rows, GROUP_ROWS))


def used_tokens(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """The vectors of ids that occur in a scope's sequences, and of its smallest
    id, which tells the width where none occurs."""
    occurring = rows.select("scope", F.explode("_ids").alias("id")).distinct()
    smallest = tokens.groupBy("scope").agg(F.min("id").alias("id"))
    return tokens.join(occurring.unionByName(smallest), ["scope", "id"], "left_semi")


def check_scopes(model: Model) -> None:
    """Raises ``ValueError`` for scopes that are not in every table of the model."""
    parts = [df.select("scope", F.lit(name).alias("part")) for name, df in model._asdict().items()]
    held = parts[0].union(parts[1]).union(parts[2]).groupBy("scope").agg(F.collect_set("part").alias("parts"))
    found = held.where(F.size("parts") < len(parts)).orderBy("scope").limit(5).collect()
    if found:
        raise ValueError(f"the model's scopes are incomplete: { {r.scope: sorted(r.parts) for r in found} }")


def _parameters(own: pa.Table) -> dict:
    """One scope's parameters as arrays indexed by id and by position."""
    token = own.filter(pc.is_valid(own.column("id")))
    ids = token.column("id").to_numpy()
    vec = np.zeros((ids.max() + 1, len(token.column("vec")[0])))
    gate, known = np.zeros(len(vec)), np.zeros(len(vec), dtype=bool)
    vec[ids], gate[ids], known[ids] = matrix(token.column("vec")), token.column("gate").to_numpy(), True
    norms = own.filter(pc.is_valid(own.column("position"))).sort_by("position")
    mean, var, gamma, beta = (norms.column(c).to_numpy() for c in ("mean", "var", "gamma", "beta"))
    slope = gamma / np.sqrt(var + C.BATCH_NORM_EPSILON)
    return {"vec": vec, "gate": gate, "known": known, "slope": slope, "shift": beta - slope * mean}


def mean_vectors(ids: np.ndarray, part: dict) -> np.ndarray:
    """Weighted means of the token vectors of each row of ``ids``."""
    inside = ids < len(part["vec"])
    safe = np.where(inside, ids, 0)
    length = ids.shape[1]
    if length > len(part["slope"]):
        raise ValueError(f"{length} ids, but norms for {len(part['slope'])} positions")
    score = part["gate"][safe] * part["slope"][:length] + part["shift"][:length]
    weight = 1.0 / (1.0 + np.exp(-score))
    weight *= (ids != 0) & inside & part["known"][safe]
    total = np.einsum("nl,nld->nd", weight, part["vec"][safe], optimize=True)
    return total / (weight.sum(axis=1, keepdims=True) + C.NORM_EPSILON)


def random_vector(scope, token, width: int, seed: int = 0):
    """A normal vector that depends on scope, token and seed only (two uniform
    hash shares per number, combined by the Box-Muller rule)."""

    def share(i, salt: str):
        value = F.xxhash64(scope, token, F.lit(f"{seed}:{salt}"), i)
        return (F.pmod(value, F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))

    return F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: F.sqrt(-2.0 * F.log(share(i, "radius")))
        * F.cos(F.lit(2.0 * np.pi) * share(i, "angle")),
    )


def transfer_embeddings(
    merged: DataFrame, base_tokens: DataFrame, width: int, seed: int = 0
) -> DataFrame:
    """Vectors of a merged vocabulary: copied by base id, else random.

    ``merged`` is the result of ``merge_vocabularies``; ``copied`` tells which
    rows came from the base.
    """
    base = base_tokens.select("scope", F.col("id").alias("base_id"), F.col("vec").alias("base_vec"))
    fresh = random_vector(F.col("scope"), F.concat_ws(":", "kind", "token"), width, seed)
    return merged.join(base, ["scope", "base_id"], "left").select(
        "scope",
        "id",
        F.coalesce(
            F.transform("base_vec", lambda x: x.cast("double")), fresh
        ).alias("vec"),
        F.col("base_vec").isNotNull().alias("copied"),
    )


def fresh_norms(gate: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Untrained normalisation: mean 0, variance 1, scale 1, shift 0."""
    query = F.substring_index("scope", "/", -1) == "query"
    length = F.when(query, lengths["query"]).otherwise(lengths["code"])
    return gate.select(
        "scope",
        F.explode(F.sequence(F.lit(0), length - 1)).alias("position"),
        F.lit(0.0).alias("mean"),
        F.lit(1.0).alias("var"),
        F.lit(1.0).alias("gamma"),
        F.lit(0.0).alias("beta"),
    )


def warm_start(
    base: Model,
    merged: DataFrame,
    width: int = C.EMBEDDING_SIZE,
    lengths: dict[str, int] | None = None,
    seed: int = 0,
) -> Model:
    """A repository model from base weights; normalisation starts afresh."""
    tokens = transfer_embeddings(merged, base.tokens, width, seed).drop("copied")
    scopes = merged.select("scope").distinct()
    gate = base.gate.join(scopes, "scope", "left_semi")
    lengths = lengths or {"code": C.CODE_LENGTH, "query": C.QUERY_LENGTH}
    return Model(tokens, gate, fresh_norms(gate, lengths))


def initial_model(
    vocabulary: DataFrame,
    width: int = C.EMBEDDING_SIZE,
    lengths: dict[str, int] | None = None,
    seed: int = 0,
) -> Model:
    """An untrained model for every scope of a vocabulary: normal token
    vectors (padding zero) and a uniform gate within 1/sqrt(width)."""
    lookup = vocabulary.groupBy("scope", "id").agg(F.min("token").alias("token"))
    vector = random_vector(F.col("scope"), F.col("token"), width, seed)
    zero = F.array_repeat(F.lit(0.0), width)
    tokens = lookup.select(
        "scope", "id", F.when(F.col("id") == 0, zero).otherwise(vector).alias("vec")
    )
    bound = float(1.0 / np.sqrt(width))
    uniform = F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: (
            F.pmod(F.xxhash64(F.col("scope"), F.lit(f"{seed}:gate"), i), F.lit(1 << 40))
            / F.lit(float(1 << 39))
            - 1.0
        )
        * bound,
    )
    gate = vocabulary.select("scope").distinct().select("scope", uniform.alias("w"))
    lengths = lengths or {"code": C.CODE_LENGTH, "query": C.QUERY_LENGTH}
    return Model(
        materialise(tokens, "tokens"),
        materialise(gate, "gate"),
        materialise(fresh_norms(gate, lengths), "norms"),
    )

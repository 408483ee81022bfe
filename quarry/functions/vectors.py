"""Vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry import constants as C


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine with the training model's guard in each norm."""
    return dot(a, b) / ((norm(a) + C.NORM_EPSILON) * (norm(b) + C.NORM_EPSILON))


def cosine_distance(a: Column, b: Column) -> Column:
    """Plain cosine distance; null for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def angular_distance(cosine_distance_: Column) -> Column:
    return F.sqrt(F.lit(2.0) * F.greatest(cosine_distance_, F.lit(0.0)))


def match_rating(angular: Column) -> Column:
    return F.round((F.lit(2.0) - angular) / 2.0 * 100.0, 1)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def rank_gain(relevance: Column, rank: Column) -> Column:
    """Discounted gain of one result."""
    return (F.pow(F.lit(2.0), relevance) - 1.0) / F.log2(rank + F.lit(1.0))


def real_ids(ids: Column) -> Column:
    """Padding mask: 1 for a real token, 0 for padding."""
    return F.transform(ids, lambda i: F.when(i != 0, 1).otherwise(0))


def has_real_id(ids: Column) -> Column:
    return F.exists(ids, lambda i: i != 0)

"""Activation: how strongly a memory answers a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ActivationWeights


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recency(last_access_at, half_life_s: float, now: float) -> Column:
    age = F.greatest(F.lit(now) - _col(last_access_at), F.lit(0.0))
    return F.pow(F.lit(0.5), age / half_life_s)


def frequency(access_count) -> Column:
    return F.log1p(F.greatest(_col(access_count), F.lit(0)).cast("double"))


def type_boost(type_, query_types, weight: float) -> Column:
    return F.when(F.array_contains(_col(query_types), _col(type_)), weight).otherwise(0.0)


def graph_factor(neighbours) -> Column:
    return F.log1p(F.coalesce(_col(neighbours), F.lit(0)).cast("double"))


def activation(similarity, last_access_at, access_count, neighbours, type_, query_types, now: float, w: ActivationWeights = ActivationWeights()) -> Column:
    return (
        w.similarity * F.greatest(_col(similarity), F.lit(0.0))
        + w.recency * recency(last_access_at, w.half_life_s, now)
        + w.frequency * frequency(access_count)
        + w.graph * graph_factor(neighbours)
        + type_boost(type_, query_types, w.type_boost)
    )


def expanded_similarity(anchor_score, depth, factor: float) -> Column:
    """What an expanded memory inherits from its anchor."""
    return F.greatest(F.lit(0.05), _col(anchor_score) * factor / _col(depth))

"""Hashes and the feature-hashing embedder (Spark has no blake2b, so these are Arrow UDFs)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import small_batches
from .text import PARTS, RUNS


def hash_hex(data: bytes, size: int = 16) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def content_hash(col, size: int = 16) -> Column:
    """blake2b of a string or binary column in hex."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hash_hex(v.encode() if isinstance(v, str) else bytes(v), size))

    return run(F.col(col) if isinstance(col, str) else col)


class _Slots(dict):
    """feature -> twice its bucket, plus 1 where its sign is negative."""

    def __missing__(self, feature: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        d = hashlib.blake2b(feature.encode(), digest_size=8).digest()
        self[feature] = slot = int.from_bytes(d[:4], "little") * 2 + (d[4] & 1)
        return slot


_slots = _Slots()
_runs, _parts = re.compile(RUNS), re.compile(PARTS)


def features(text: str | None) -> list[str]:
    """``text.features`` of one text."""
    tokens: list[str] = []
    for run in _runs.findall(text or ""):
        tokens += _parts.findall(run) or (run,)
    tokens = [t.lower() for t in tokens]
    return tokens + [f"{a}_{b}" for a, b in zip(tokens, tokens[1:])]


def hash_vector(feats, dim: int) -> np.ndarray:
    slots = np.fromiter(map(_slots.__getitem__, feats), np.int64)
    out = np.bincount((slots >> 1) % dim, 1.0 - 2.0 * (slots & 1), dim)
    norm = np.sqrt((out * out).sum())
    return (out / (norm or 1.0)).astype(np.float32)


def hash_embed(text, dim: int = 256) -> Column:
    """Signed feature hashing of tokens and token pairs, unit length. Texts reach the worker in small batches, not their features."""
    if spark := SparkSession.getActiveSession():
        small_batches(spark)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: hash_vector(features(t), dim))

    return run(F.col(text) if isinstance(text, str) else text)


def embed_with(embed_batch: Callable[[list[str]], np.ndarray], text) -> Column:
    """Any provider: a function from texts to a matrix. Equal texts of a batch are embedded once."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        distinct = list(dict.fromkeys(texts.fillna("")))
        rows = dict(zip(distinct, np.asarray(embed_batch(distinct), np.float32))) if distinct else {}
        return texts.fillna("").map(rows)

    return run(F.col(text) if isinstance(text, str) else text)


_named: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register(name: str, embed_batch: Callable[[list[str]], np.ndarray]) -> None:
    """Name an embedding provider."""
    _named[name] = embed_batch


def named(name: str) -> Callable[[Column], Column]:
    """The embedding of a registered provider, for use wherever an operator takes one."""
    if name not in _named:
        raise KeyError(f"no embedding provider is registered as {name}; known: {sorted(_named)}")
    embed_batch = _named[name]
    return lambda text: embed_with(embed_batch, text)

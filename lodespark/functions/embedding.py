"""Embeddings: feature hashing of tokens and trigrams, and models behind a small protocol."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespark.functions.text import tokenize

DIMENSION = 384
LONG, LONG_WEIGHT, GRAM_WEIGHT = 6, 1.4, 0.35
#: What models want in front of a query and of a passage.
PREFIXES = {"e5": ("query: ", "passage: "), "mxbai": ("Represent this sentence for searching relevant passages: ", "")}


@lru_cache(200_000)
def _bucket(feature: str) -> tuple[int, float]:
    d = hashlib.sha256(feature.encode()).digest()
    return int.from_bytes(d[:4], "big") % DIMENSION, 1.0 if d[4] % 2 == 0 else -1.0


@lru_cache(100_000)
def _token(token: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights that one occurrence of a token adds."""
    features = [(token, LONG_WEIGHT if len(token) >= LONG else 1.0)] + [("ngram:" + token[k : k + 3], GRAM_WEIGHT) for k in range(len(token) - 2)]
    places = [(*_bucket(f), w) for f, w in features]
    return np.array([i for i, _, _ in places]), np.array([s * w for _, s, w in places])


def hashed(text: str) -> list[float]:
    """384 numbers: every token adds 1.4 or 1 by length, every trigram 0.35, at a bucket and sign from SHA-256; unit length.

    A text without tokens gives zeros.
    """
    counts = Counter(tokenize(text))
    if not counts:
        return [0.0] * DIMENSION
    own = [_token(t) for t in counts]
    times = np.repeat(np.fromiter(counts.values(), float, len(counts)), [len(i) for i, _ in own])
    v = np.bincount(np.concatenate([i for i, _ in own]), np.concatenate([w for _, w in own]) * times, DIMENSION)
    norm = math.sqrt(float(v @ v))
    return (v / norm if norm else v).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embedding(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hashed(t))


def prefixed(text: Column, model: str, query: bool) -> Column:
    """The text with what the model's family wants in front."""
    kind = next((k for k in PREFIXES if k in model.lower()), None)
    return F.concat(F.lit(PREFIXES[kind][0 if query else 1]), text) if kind else text


def model_embedding(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """A batch UDF from a loader; the model is loaded once per worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts.fillna("")
            yield pd.Series([None if t is None else list(map(float, v)) for t, v in zip(texts, model(list(known)))])

    return embed

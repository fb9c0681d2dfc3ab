"""Pluggable model calls; the defaults need no network and are deterministic."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestrata.session import ship

DIMENSION = 64
#: Texts that a model is given at once.
BATCH = 100
_WORDS = re.compile(r"[a-z]+|[^\W\d_a-z]|\d+")
_HUMPS = re.compile(r"([a-z0-9])([A-Z])")
#: The same words in a text of ASCII letters, in any case.
_PLAIN_WORDS = re.compile(r"[A-Z]+[a-z]*|[a-z]+|\d+")


def hash_embeddings(texts: list[str | None], dimension: int = DIMENSION) -> np.ndarray:
    """A unit vector of hashed words for each text, humps and underscores parted; zeros for a text without words."""
    words: list[str] = []
    counts = []
    for text in texts:
        if not text:
            counts.append(0)
            continue
        # without humps to part and letters that change their number, one pattern finds the same words
        found = _PLAIN_WORDS.findall(text) if text.isascii() else _WORDS.findall(_HUMPS.sub(r"\1 \2", text).lower())
        counts.append(len(found))
        words.extend(found)
    codes = {word: zlib.crc32(word.lower().encode()) for word in set(words)}
    rows = np.repeat(np.arange(len(texts)), counts)
    hashed = np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))
    vectors = np.bincount(
        rows * dimension + hashed % dimension, weights=np.where(hashed & 0x10000, 1.0, -1.0), minlength=len(texts) * dimension
    ).reshape(len(texts), dimension)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths == 0, 1.0, lengths)


def hash_embedding(text: str | None, dimension: int = DIMENSION) -> list[float]:
    """The vector of one text."""
    return hash_embeddings([text], dimension)[0].tolist()


def embed(text: Column, model: Callable[[list[str | None]], np.ndarray] = hash_embeddings, batch: int = BATCH) -> Column:
    """The vectors of a text column; the model is given `batch` texts at a time."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        parts = [np.asarray(model(list(texts.iloc[at : at + batch]))) for at in range(0, len(texts), batch)]
        return pd.Series([row for part in parts for row in part])

    return vectors(text)


def summarize(kind: Column, name: Column, docstring: Column, signature: Column) -> Column:
    """A one-line summary from a template: the first line of the documentation, or the signature."""
    first = F.regexp_extract(F.trim(docstring), r"^([^\n]*)", 1)
    return F.concat_ws(" ", F.initcap(kind), name, F.lit("-"), F.coalesce(F.nullif(first, F.lit("")), signature, F.lit("no description")))

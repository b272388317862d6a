"""Vectors of texts and their products."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays, in double precision and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector scaled to norm 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


class Embedder(Protocol):
    """What turns texts into vectors of one length and norm 1."""

    name: str

    def __call__(self, texts: list[str]) -> np.ndarray: ...


#: Numbers of a vector that a token marks.
MARKS = 8


@lru_cache(maxsize=1 << 16)
def _marks(token: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and signs that a token marks: one place in each of ``MARKS`` stripes of the vector."""
    marks = min(MARKS, width)
    digest = np.frombuffer(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8 * MARKS).digest(), dtype="<u8")[:marks]
    stripe = width // marks
    places = np.arange(marks) * stripe + ((digest >> np.uint64(1)) % np.uint64(stripe)).astype(np.int64)
    return places, np.where(digest & np.uint64(1), 1.0, -1.0)  # whole numbers, so that the order of words changes nothing


class HashedTokens:
    """Signed sketch of the frequencies of lower-case tokens, of ``width`` numbers; needs no model and gives equal texts equal vectors.

    A token marks eight places with signs. Two tokens count as equal only if all eight agree; that one of them does, which
    moves their product from 0 to 1/8 or -1/8, has a probability of about 64 / width. So cosines are those of token
    frequencies, but for noise of about 1 / root of width; at the default, an eighth for one pair of tokens in 32.
    """

    def __init__(self, width: int = 2048):
        self.width, self.name = width, f"hashed-tokens-{MARKS}-{width}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for i, t in enumerate(texts):
            for token, n in Counter(t.lower().split()).items():
                places, signs = _marks(token, self.width)
                out[i, places] += n * signs
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


#: Models that this worker process has loaded, by name.
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


class Model:
    """A model that each worker loads once, when it first meets it; only its name and ``load`` are sent to the workers."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.name, self.load = name, load

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name](texts)


def in_halves(embedder: Embedder, texts: list[str]) -> np.ndarray:
    """The vectors of texts; where memory doesn't suffice for all, those of either half."""
    try:
        return np.asarray(embedder(texts), dtype=np.float32)
    except MemoryError:
        if len(texts) < 2:
            raise
    half = len(texts) // 2
    return np.concatenate([in_halves(embedder, texts[:half]), in_halves(embedder, texts[half:])])


#: Texts whose vectors a task holds at a time.
TEXTS = 256


def embed(df: DataFrame, text: str, embedder: Embedder, to: str = "embedding") -> DataFrame:
    """Adds the vector of a text column, on the executors; a null text counts as empty.

    A task holds the vectors of ``TEXTS`` texts at a time, however many rows Spark sends in a batch.
    """
    rest = [c for c in df.columns if c != to]
    at = df.columns.index(text)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), TEXTS):
                part = batch.slice(lo, TEXTS)
                made = in_halves(embedder, [t or "" for t in part.column(at).to_pylist()])
                ends = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
                listed = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(made).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), listed], names=[*rest, to])

    kept = [f for f in df.schema if f.name != to]
    return df.mapInArrow(vectors, T.StructType([*kept, T.StructField(to, T.ArrayType(T.FloatType()))]))

"""Embedding backends.

A backend turns a text column into an ``array<float>`` column of fixed width, L2-normalised
and stored as float32.  Two kinds:

* ``HashingEmbedder`` (deterministic default): lower-cased words -> ``md5`` -> first 8 hex
  digits as an integer mod ``dim``; counts per row, L2-normalised.  ``buckets`` states the rule
  as a JVM expression; ``column`` runs it in an iterator pandas UDF with a per-worker
  word cache and vectorised ``bincount``s over a batch (measured several times cheaper than
  hashing every word occurrence on the JVM, because vocabularies repeat).
* ``PandasEmbedder``: wraps any ``list[str] -> matrix`` callable (e.g. a neural sentence
  encoder) as an iterator pandas UDF; the model is built once per Python worker and called
  in inner batches (32 by default, as the reference batches its encoder).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import words
from tessera.operators.models import built, in_batches
from tessera.session import bound_batches

DEFAULT_DIM = 384
EMBED_BATCH = 32


_CACHE_LIMIT = 100_000   # words, some 15 MB of a worker; frequent ones are soon back


class _Buckets(dict):
    """Word -> bucket memo of this Python worker; md5 runs once per distinct word while it lasts."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        b = self[word] = int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:4], "big") % self.dim
        return b


_CACHES: dict[int, _Buckets] = {}


_CELLS = 1 << 17   # of a matrix that a worker holds at a time, 1 MB as doubles


def _parts(n: int, dim: int) -> Iterator[slice]:
    """The rows of a batch by ``_CELLS``.  A batch is bounded by the bytes of its texts: ten thousand short ones make a matrix of
    30 MB as doubles, wider ones more, held several times over and as a list of Python's numbers when Spark takes it back."""
    step = max(1, _CELLS // dim)
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def _bags(texts: pd.Series, dim: int) -> Iterator[np.ndarray]:
    """Normalised counts of words per text and bucket, by ``_parts``.  Words are told apart in Arrow; only distinct ones are looked up."""
    words = [t.lower().split() if t is not None else [] for t in texts]
    n, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array(chain.from_iterable(words), pa.string(), size=int(lens.sum())).dictionary_encode()
    bucket = _CACHES.setdefault(dim, _Buckets(dim)).__getitem__
    of_word = np.fromiter(map(bucket, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    flat = of_word[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lens)])
    for part in _parts(n, dim):
        rows = np.repeat(np.arange(part.stop - part.start, dtype=np.int64), lens[part])
        cells = rows * dim + flat[ends[part.start]:ends[part.stop]]
        counts = np.bincount(cells, minlength=(part.stop - part.start) * dim).reshape(-1, dim)
        yield _normalise_f32(counts.astype(np.float64))


def _normalise_f32(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1))
    out = np.zeros_like(m, dtype=np.float64)
    nz = norms > 0
    out[nz] = m[nz] / norms[nz, None]
    return out.astype(np.float32)


def _series_of_rows(m: np.ndarray) -> pd.Series:
    return pd.Series(list(m))


class HashingEmbedder:
    """Bag of hashed lower-case words; weight = count / L2 norm of the counts."""

    def __init__(self, dim: int = DEFAULT_DIM):
        if dim < 1:
            raise ValueError("dim must be >= 1")
        self.dim = dim

    def buckets(self, text) -> Column:
        """Bucket id of every word, computed in the JVM."""
        c = F.col(text) if isinstance(text, str) else text
        dim = self.dim
        return F.transform(words(F.lower(c)), lambda w: F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))

    def column(self, text) -> Column:
        """Iterator pandas UDF over the text: ``str.lower().split()`` words, bucket per word
        through a per-worker cache (vocabularies repeat, so md5 runs once per distinct word),
        ``bincount``s over a batch, L2 normalisation, float32.  Same buckets as ``buckets``."""
        dim = self.dim

        @F.pandas_udf("array<float>")
        def bag(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in it:
                yield from map(_series_of_rows, _bags(texts, dim))

        return bag(F.col(text) if isinstance(text, str) else text)


def _encoded(model: Callable[[list[str]], np.ndarray], texts: list[str], dim: int, batch_size: int, budget: int | None) -> list[np.ndarray]:
    """Normalised vectors of the texts; each of the model's batches is float32 before the next is made."""
    def vectors(part: list[str]) -> np.ndarray:
        m = np.ascontiguousarray(model(part), dtype=np.float64)
        m = m.reshape(len(m), -1)
        if m.shape[1] != dim:
            raise ValueError(f"model returned width {m.shape[1]}, expected {dim}")
        return _normalise_f32(m)
    return in_batches(vectors, [texts], batch_size, budget)


class PandasEmbedder:
    """Any ``texts -> (n, dim) matrix`` model as an Arrow-batched pandas UDF."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int,
                 batch_size: int = EMBED_BATCH, budget: int | None = None):
        """``budget``: words of a batch, texts sorted by length, instead of ``batch_size`` texts."""
        self.factory, self.dim, self.batch_size, self.budget = factory, dim, batch_size, budget
        self.key = uuid.uuid4().hex

    def column(self, text) -> Column:
        factory, dim, bs, key, budget = self.factory, self.dim, self.batch_size, self.key, self.budget

        @F.pandas_udf("array<float>")
        def enc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = built(key, factory)
            for s in it:
                rows = _encoded(model, s.fillna("").tolist(), dim, bs, budget)
                yield from (pd.Series(rows[part]) for part in _parts(len(rows), dim))

        c = F.col(text) if isinstance(text, str) else text
        return enc(c)


def model_name(embedder) -> str:
    """The name stored beside a backend's vectors: its ``name``, or its class and width."""
    return getattr(embedder, "name", None) or f"{type(embedder).__name__}-{embedder.dim}"


def embed_chunks(chunks: DataFrame, embedder=None, text_col: str = "content") -> DataFrame:
    """Chunks with an ``embedding`` column in the same row (text and vector cannot part)."""
    emb = embedder or HashingEmbedder()
    bound_batches(chunks.sparkSession)
    return chunks.withColumn("embedding", emb.column(text_col))


def long_form(df: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, bucket, weight``: non-zero entries of the stored float32 vector, as double."""
    pairs = F.transform("embedding", lambda w, i: F.struct(i.alias("bucket"), w.alias("w")))
    x = df.select(key, F.explode(F.filter(pairs, lambda p: p["w"] != 0)).alias("p"))   # zeros never become rows
    return x.select(key, F.col("p.bucket").cast("int").alias("bucket"),
                    F.round(F.col("p.w").cast("double"), 6).alias("weight"))


def vector_summary(df: DataFrame) -> DataFrame:
    """Per vector: non-zero width, strongest bucket (lowest on ties) and its weight."""
    top = F.array_max("embedding")
    return df.select(
        "chunk_id", "document_id",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"),
        (F.array_position("embedding", top) - 1).cast("int").alias("top_bucket"),
        F.round(top.cast("double"), 6).alias("top_weight"))

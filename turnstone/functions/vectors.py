"""Vectors: cosine similarity, and embedders: one that needs no model, and two that call one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnstone.functions import text as x

DIMENSIONS = 384
Embedder = Callable[[Column], Column]


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that have the given width, in double precision, and which rows these are."""
    own = np.asarray(column.value_lengths().fill_null(-1)) == width
    if not own.all():
        column = column.filter(pa.array(own))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width), np.flatnonzero(own)


def cosines(query: Sequence[float]) -> Callable[[Column], Column]:
    """Similarity to one query, a matrix product a batch; null for zero vectors, nulls and other lengths."""
    q = np.asarray(query, float)
    q = q / np.linalg.norm(q) if q.any() else q

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        rows, own = matrix(vectors, len(q))
        norms = np.linalg.norm(rows, axis=1)
        out = np.full(len(vectors), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[own] = np.where(norms > 0, rows @ q / norms, np.nan) if q.any() else np.nan
        return pa.array(out, mask=np.isnan(out))

    return score


def hashed_counts(dimensions: int = DIMENSIONS) -> Callable[[Column], Column]:
    """Hashes of words as a vector of signed counts, unit norm; a batch is counted at once."""

    @F.arrow_udf("array<float>")
    def count(hashes: pa.Array) -> pa.Array:
        sizes = np.asarray(hashes.value_lengths().fill_null(0))
        h = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(hashes)), sizes)
        out = np.bincount(row * dimensions + h % dimensions, np.where(h & 0x80000000, 1.0, -1.0), len(hashes) * dimensions).astype(float).reshape(-1, dimensions)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * dimensions), pa.array(out.ravel().astype(np.float32)))

    return count


def hashed_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Hashed bag of words with signs, unit norm: the same text has the same vector in every run. The JVM cuts and hashes
    words; a batch is counted at once."""
    count = hashed_counts(dimensions)

    def embed(text: Column) -> Column:
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
        return count(F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint")))

    return embed


def model_embedder(name: str = "all-MiniLM-L6-v2") -> Embedder:
    """A sentence-transformers model, loaded once a worker."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist())), dtype=object).map(lambda v: [float(e) for e in v])

    return embed


def http_embedder(url: str, model: str, timeout: float = 60) -> Embedder:
    """A model behind POST {url}/api/embeddings; texts are stripped and cut to the fixed length, an empty answer fails."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json
        from urllib.request import Request, urlopen

        def one(text: str | None) -> list[float]:
            body = json.dumps({"model": model, "prompt": (text or "").strip()[: x.PROMPT_CHARS]}).encode()
            asked = Request(f"{url.rstrip('/')}/api/embeddings", body, {"Content-Type": "application/json", "Accept": "application/json"}, method="POST")
            with urlopen(asked, timeout=timeout) as answer:
                vector = json.load(answer).get("embedding")
            if not isinstance(vector, list) or not vector:
                raise RuntimeError("the embeddings service returned an empty vector")
            return [float(v) for v in vector]

        for texts in batches:
            yield texts.map(one)

    return embed


def choose_embedder(backend: str = "auto", url: str = "http://127.0.0.1:11434", http_model: str = "", model: str = "all-MiniLM-L6-v2") -> Embedder:
    """By name: st (also sentence-transformers), ollama or http, hashed. auto takes the service if a model of it is named,
    else sentence-transformers if installed, else the hashed one."""
    from importlib.util import find_spec

    kind = backend.strip().lower()
    if kind == "auto":
        kind = "http" if http_model else "st" if find_spec("sentence_transformers") else "hashed"
    if kind in ("st", "sentence-transformers", "sentencetransformers"):
        return model_embedder(model)
    if kind in ("ollama", "http"):
        return http_embedder(url, http_model)
    if kind == "hashed":
        return hashed_embedder()
    raise ValueError(f"no backend {backend}")

"""Vectors of chunks through a pluggable embedder, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


class Embedder(Protocol):
    """``encode`` gives a row of ``dimensions`` numbers for each text."""

    dimensions: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic embedder: hashed counts of words and of three letters, signed, of length 1."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w+", text.lower())
            for g in [*words, *(w[i : i + 3] for w in words for i in range(len(w) - 2))]:
                h = xxhash.xxh64_intdigest(g)
                row[h % self.dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class HttpEmbedder:
    """An embedder behind an HTTP interface that takes ``{"model", "input"}`` and gives ``{"data": [{"embedding"}]}``."""

    def __init__(self, url: str, model: str, dimensions: int, key: str = "", batch: int = 16):
        self.url, self.model, self.dimensions, self.key, self.batch = url, model, dimensions, key, batch

    def encode(self, texts: list[str]) -> np.ndarray:
        import json
        import urllib.request

        out = []
        for i in range(0, len(texts), self.batch):
            body = json.dumps({"model": self.model, "input": texts[i : i + self.batch]}).encode()
            request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            with urllib.request.urlopen(request, timeout=60) as answer:
                out += [d["embedding"] for d in json.load(answer)["data"]]
        return np.array(out, float).reshape(len(texts), -1)


REGISTRY: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder, "http": HttpEmbedder}


def embed(df: DataFrame, text: Column, embedder: Embedder, name: str | None = None, batch: int = 256) -> DataFrame:
    """Adds ``q_{dimensions}_vec``; empty texts are encoded as "None"."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [t if isinstance(t, str) and t.strip() else "None" for t in part]
            rows = [embedder.encode(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(rows).astype(np.float32)) if rows else [], dtype=object)

    return df.withColumn(name or f"q_{embedder.dimensions}_vec", encode(text))


def embed_chunks(df: DataFrame, embedder: Embedder, title: str = "docnm_kwd", content: str = "content_with_weight", questions: str = "question_kwd", title_weight: float = 0.1) -> DataFrame:
    """A chunk's vector: its questions' if it has any, else its content's without table tags, blended with its title's."""
    text = F.when(F.size(F.coalesce(questions, F.array().cast("array<string>"))) > 0, F.array_join(questions, "\n")).otherwise(T.strip_table_tags(F.col(content)))
    out = embed(embed(df, F.col(title), embedder, "_t"), text, embedder, "_c")
    return out.withColumn(f"q_{embedder.dimensions}_vec", V.blend(F.col("_t"), F.col("_c"), title_weight).cast("array<float>")).drop("_t", "_c")

"""Embedding of chunks and queries behind a protocol; an offline embedder that hashes words stands in for a model."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.functions import text as T


class Embedder(Protocol):
    """Turns a batch of texts into a matrix; must be picklable. Clients of a model service reorder by index themselves."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed word counts in `dimension` slots: deterministic and offline; says nothing about the quality of a model."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                code = crc32(word.encode())
                row[code % self.dimension] += 1.0 if code & (1 << 31) else -1.0
        return out


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "text", prompt: str = "", normalize: bool = True, batch: int = 64) -> DataFrame:
    """rows with embedding (array of floats); texts go to the embedder `batch` at a time, after the prompt."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prompted = [prompt + (t or "") for t in texts]
            parts = [np.asarray(embedder.embed(prompted[k : k + batch]), np.float32) for k in range(0, len(prompted), batch)]
            m = np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)
            if normalize and len(m):
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(m.astype(np.float32)))

    return rows.withColumn("embedding", run(F.col(text_col)))


def embedding_rows(chunks: DataFrame, embedder: Embedder, prompt: str = "", metadata: bool = True, dry_run: bool = False, limit: int | None = None, required: bool = False) -> DataFrame:
    """chunk columns, text_sha1 (of the text with metadata, without the prompt) and embedding; no embedding in a dry run.

    limit: that many chunks, the first by paper and place. required: no chunks at all are refused.
    """
    if limit is not None:
        if limit < 1:
            raise ValueError("limit must be at least 1")
        chunks = chunks.orderBy("paper_id", "chunk_index", "chunk_id").limit(limit)
    if required and chunks.isEmpty():
        raise ValueError("there are no chunks to embed")
    text = T.render_dense(F.col("title"), F.col("section_path"), F.col("living_review_categories"), F.col("text")) if metadata else F.col("text")
    rows = chunks.withColumn("__text", text).withColumn("text_sha1", F.sha1("__text"))
    return (rows if dry_run else embed(rows, embedder, "__text", prompt)).drop("__text")


def embed_queries(queries: DataFrame, embedder: Embedder, prompt: str = T.QUERY_PROMPT) -> DataFrame:
    return embed(queries.withColumn("query", F.trim("query")), embedder, "query", prompt)

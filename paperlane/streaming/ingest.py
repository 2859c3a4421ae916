"""Chunks from a stream of files: each micro-batch is embedded and merged into the next version of the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperlane.operators.embedding import Embedder
from paperlane.plans.pipelines import index_chunks
from paperlane.sources.files import CHUNK, upsert


def stream_chunks(spark: SparkSession, source: str, store: str, checkpoint: str, embedder: Embedder, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Reads JSON lines of chunks that appear under `source`; version n of the table is `store`/v=n, where n is the batch id + 1.

    A batch that is run again after a failure writes the same version from the same predecessor, so it counts once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = index_chunks(prepare(batch) if prepare else batch, embedder)
        if number:
            rows = upsert(spark.read.parquet(f"{store}/v={number}"), rows)
        rows.write.mode("overwrite").parquet(f"{store}/v={number + 1}")

    stream = spark.readStream.schema(CHUNK).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

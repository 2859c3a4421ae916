"""A chunk table that a stream keeps up to date by writing what is new, and no more.

`store`/delta/batch=n holds the rows of batch n, the last of each key. `store`/base/upto=n holds one row a key from all batches up to n. The table is the latest base and the
deltas behind it, of each key the row of the latest batch. A batch that is run again after a failure overwrites its own delta with the same rows, so it counts once. compact()
folds the deltas into a new base when they have grown to a share of the base: over time a row is rewritten a logarithmic number of times, not with every batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlane.operators.embedding import Embedder
from paperlane.plans.pipelines import index_chunks
from paperlane.plans.stored import drop_folder
from paperlane.sources.files import CHUNK, upsert

#: Bytes of deltas, as a share of the base's, at which they are folded in.
SHARE = 0.25


def _versions(spark: SparkSession, store: str, kind: str) -> dict[int, int]:
    """number: bytes, of the folders that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{kind}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    if system.exists(path):
        for status in system.listStatus(path):
            folder = status.getPath()
            m = re.fullmatch(r"(?:batch|upto)=(\d+)", folder.getName())
            if m and system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                out[int(m[1])] = system.getContentSummary(folder).getLength()
    return out


def _parts(spark: SparkSession, store: str) -> tuple[int | None, list[int]]:
    """The latest base, if there is one, and the batches behind it."""
    base = max(_versions(spark, store, "base"), default=None)
    return base, sorted(n for n in _versions(spark, store, "delta") if base is None or n > base)


def write_delta(rows: DataFrame, store: str, number: int, key: str = "chunk_id") -> None:
    """The rows of one batch, the last of each key, as upsert() would take them."""
    upsert(rows.limit(0), rows, key).write.mode("overwrite").parquet(f"{store}/delta/batch={number}")


def current(spark: SparkSession, store: str, key: str = "chunk_id") -> DataFrame:
    """The table as of now: one row a key."""
    base, deltas = _parts(spark, store)
    if base is None and not deltas:
        raise FileNotFoundError(f"no table in {store}")
    read = lambda path, n: spark.read.parquet(path).withColumn("__batch", F.lit(n))
    new = None
    for n in deltas:
        part = read(f"{store}/delta/batch={n}", n)
        new = part if new is None else new.unionByName(part)
    if new is None:
        return spark.read.parquet(f"{store}/base/upto={base}")
    # Which batch is a key's last is found by the keys alone; wide rows are not grouped.
    last = new.groupBy(key).agg(F.max("__batch").alias("__batch"))
    new = new.join(last, [key, "__batch"], "left_semi").drop("__batch")
    return new if base is None else spark.read.parquet(f"{store}/base/upto={base}").join(last.select(key), key, "left_anti").unionByName(new)


def compact(spark: SparkSession, store: str, key: str = "chunk_id", share: float = SHARE) -> bool:
    """Folds the deltas into a new base if their bytes are `share` of the base's or more. What came before stays until vacuum(), for readers that are at it."""
    base, deltas = _parts(spark, store)
    if not deltas:
        return False
    sizes, old = _versions(spark, store, "delta"), _versions(spark, store, "base").get(base, 0)
    if sum(sizes[n] for n in deltas) < share * old:
        return False
    current(spark, store, key).write.mode("overwrite").parquet(f"{store}/base/upto={deltas[-1]}")
    return True


def vacuum(spark: SparkSession, store: str) -> None:
    """Deletes bases but the latest, and deltas that it holds."""
    base, _ = _parts(spark, store)
    for kind, name in (("base", "upto"), ("delta", "batch")):
        for n in _versions(spark, store, kind):
            if base is not None and (n < base or kind == "delta" and n == base):
                drop_folder(spark, f"{store}/{kind}/{name}={n}")


def stream_deltas(spark: SparkSession, source: str, store: str, checkpoint: str, embedder: Embedder, prepare: Callable[[DataFrame], DataFrame] | None = None, share: float = SHARE) -> StreamingQuery:
    """Reads JSON lines of chunks that appear under `source` and writes each batch's delta; then compacts, if the deltas have grown to `share` of the base."""

    def merge(batch: DataFrame, number: int) -> None:
        write_delta(index_chunks(prepare(batch) if prepare else batch, embedder), store, number)
        compact(batch.sparkSession, store, share=share)

    stream = spark.readStream.schema(CHUNK).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

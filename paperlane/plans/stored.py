"""Tables kept for later steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bound on the batches that go to Python workers, and its setting.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Folders that the run in this context has written; None outside a run.
_OWN: ContextVar[list[str] | None] = ContextVar("paperlane_folders", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); one of our own only where that is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="paperlane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A name in the shared folder that nothing else has; the run around it, if there is one, deletes the folder at its end."""
    path = f"{shared_dir(spark)}/paperlane/{tag}-{uuid.uuid4().hex}"
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of BATCH_BYTES at most (one row at least), unless the session says otherwise: a bound on a worker's memory however long rows are."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def over(df: DataFrame, n: int) -> DataFrame:
    """df in n partitions; partitions are put together without a shuffle if there are more."""
    return df.coalesce(n) if df.rdd.getNumPartitions() >= n else df.repartition(n)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read again: what stands before it runs once, whatever is read how often, and lost executors take nothing with them."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def run(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what stored() wrote within it, in this thread alone: two runs do not touch each other's folders. What is to outlast the run must be written, or taken out of the list, by then."""
    own: list[str] = []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)
        for path in own:
            drop_folder(spark, path)


def result(df: DataFrame, own: list[str], tag: str = "result") -> DataFrame:
    """df stored so that it outlasts the run whose list is `own`; drop() deletes it."""
    kept = stored(df, tag)
    own.remove(next(p for p in reversed(own) if p.rpartition("/")[2].startswith(f"{tag}-")))
    return kept


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/paperlane/" in folder:
            drop_folder(df.sparkSession, folder)

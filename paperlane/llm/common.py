"""What the corpus operators share: the shared folder, cut points in the lineage, fold tests and row keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.plans.stored import drop_folder, new_folder, small_batches

#: Folders that cut() has written and nobody has deleted, of all runs in this process.
WRITTEN: list[str] = []
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: lineage ends here and survives lost executors. by: a column whose values get folders of their own."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, tag)
    df.write.parquet(path, partitionBy=by)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders that cut() has written, and empties the list; for callers that have stored what they need of them. A run's own list is that of stored.run()."""
    for folder in folders:
        drop_folder(spark, folder)
        if folder in WRITTEN:
            WRITTEN.remove(folder)
    folders.clear()


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; a text of ASCII alone (as many bytes as characters) goes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo `of`; null ids fall in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(of), F.lit(0))


def row_count_at_most(df: DataFrame, bound: int) -> bool:
    """True if df has at most `bound` rows; reads no more than bound + 1 of them."""
    return df.limit(bound + 1).count() <= bound


def hash_order(doc_id: Column, salt: int) -> Column:
    """A fixed pseudo-random order of ids, for bounded samples that do not depend on partitioning."""
    return F.xxhash64(doc_id, F.lit(salt))


def drawn(ids: DataFrame, column: str, most: int, salt: int) -> DataFrame:
    """At most `most` distinct ids, by a hash: one threshold for all rows, so that no task sees more than its share."""
    of = F.pmod(hash_order(F.col(column), salt), F.lit(1 << 32))
    bound = (1 << 32) * min(1.0, 1.05 * most / max(1, ids.count()))
    return ids.where(of < F.lit(int(bound))).select(column).distinct().orderBy(hash_order(F.col(column), salt), column).limit(most)


def auc(scores, labels) -> float:
    """Area under the ROC curve, ties counted half."""
    import numpy as np

    scores, labels = np.asarray(scores, float), np.asarray(labels, int)
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    if not pos or not neg:
        return math.nan
    _, place, counts = np.unique(scores, return_inverse=True, return_counts=True)
    mid = np.cumsum(counts) - (counts - 1) / 2
    return float((mid[place][labels == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))

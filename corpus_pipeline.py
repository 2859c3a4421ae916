"""The corpus pipeline: quality, line dedup, near dedup, decontamination, packing; each stage reads what its predecessor wrote.

Columns of documents whose names begin with two underscores are refused: the operators use such names on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.llm import decontaminate, line_dedup, near_dedup, packing, quality
from paperlane.llm.common import cut, fold, release
from paperlane.llm.queries import table, tokenizer_path
from paperlane.plans import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Labels and documents outside the test fold teach it."""
    taught = lambda df: df.where(fold(F.col("doc_id"), 5) != 0)
    model = quality.train(taught(docs), taught(table(spark, sf_dir, "labels")))
    return quality.score(docs, model, out="__score").where(F.col("__score") >= quality.THRESHOLD).drop("__score")


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur over their source."""
    return line_dedup.drop_boilerplate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", keep_good), ("line_dedup", cut_boilerplate), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("packing", pack)]

#: Learning, signatures and tokenizing have no form in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written and read again; what led to it is then deleted: folders of this run alone, whatever else runs."""
    docs = table(spark, sf_dir, "documents")
    if own_names := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns {own_names} bear names that the stages use themselves")
    with stored.run(spark) as own:
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept = own.pop()
            release(spark, own)
            own.append(kept)
        own.clear()  # the last stage's rows outlast the run
    return docs

"""Chunks of papers: one for each paragraph, long ones split at sentences unless they hold display math."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlane.functions import text as T

MAX_TOKENS = 600


def chunk_paragraphs(paragraphs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """paragraphs (paper_id, pos, kind, section_path, text, paragraph_id and any paper columns) to chunks.

    One shuffle, by paper, for the running index; splitting is done in place. The index counts pieces over the whole paper.
    """
    long = (T.count_words(F.col("text")) > max_tokens) & ~T.has_display_math(F.col("text"))
    pieces = F.when(long, T.pack_sentences(F.col("text"), max_tokens)).otherwise(F.array("text"))
    keep = [c for c in paragraphs.columns if c not in ("text", "pos", "kind", "paragraph_id")]
    split = paragraphs.select(*keep, "pos", F.col("kind").alias("chunk_type"), F.array("paragraph_id").alias("paragraph_ids"), F.posexplode(pieces).alias("piece", "text"))
    order = Window.partitionBy("paper_id").orderBy("pos", "piece")
    numbered = split.withColumn("chunk_index", F.row_number().over(order) - 1)
    return numbered.withColumns({"token_count": T.count_words(F.col("text")).cast("int"), "chunk_id": T.chunk_id(F.col("paper_id"), F.col("section_path"), F.col("chunk_index"), F.col("text"))}).drop("pos", "piece")


def paper_records(papers: DataFrame, paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """papers with paragraph_count and chunk_count."""
    n = paragraphs.groupBy("paper_id").agg(F.count("*").cast("int").alias("paragraph_count"))
    m = chunks.groupBy("paper_id").agg(F.count("*").cast("int").alias("chunk_count"))
    return papers.join(n, "paper_id", "left").join(m, "paper_id", "left").fillna(0, ["paragraph_count", "chunk_count"])

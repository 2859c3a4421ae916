"""Fusion, reranking and diversification of ranked hits; every frame is keyed by query_id."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperlane.operators.vector import top_by

RRF_K = 60


def fuse(vector_hits: DataFrame, lexical_hits: DataFrame, k: int, rrf_k: int = RRF_K, id_col: str = "chunk_id", digits: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked pools (rank, score); the score of a pool without the id is null. With digits, sums equal to so many places are ties."""
    if k < 1 or rrf_k < 1:
        raise ValueError("candidate_k and rrf_k must be at least 1")
    v = vector_hits.select("query_id", id_col, "vector_score", F.col("rank").alias("vector_rank"))
    x = lexical_hits.select("query_id", id_col, "lexical_score", F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = v.join(x, ["query_id", id_col], "full_outer").withColumn("rrf_score", part("vector_rank") + part("lexical_rank"))
    return top_by(both, k, (F.col("rrf_score") if digits is None else F.round("rrf_score", digits)).desc(), id_col)


class Scorer(Protocol):
    """Relevance of documents to a query, one score each; must be picklable."""

    def score(self, query: str, documents: list[str]) -> list[float]: ...


class OverlapScorer:
    """Share of the query's distinct words in the document: an offline stand-in, no model."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(d.lower().split())) / max(1, len(wanted)) for d in documents]


def parse_scores(body: Column, n: Column) -> Column:
    """Scores in document order from a service's JSON; null unless each of n documents has one. Items come under `results` or
    `data`, numbered by index, corpus_id or their place, scored by relevance_score or score."""
    item = "array<struct<index:int,corpus_id:int,relevance_score:double,score:double>>"
    parsed = F.from_json(body, f"results {item}, data {item}")
    items = F.transform(F.coalesce(parsed["results"], parsed["data"]), lambda x, i: F.struct(F.coalesce(x["index"], x["corpus_id"], i).alias("i"), F.coalesce(x["relevance_score"], x["score"]).alias("s")))
    ordered = F.array_sort(items)
    whole = (F.size(items) == n) & F.forall(F.transform(ordered, lambda x, i: F.struct((x["i"] == i).alias("ok"), x["s"].isNotNull().alias("has"))), lambda x: x["ok"] & x["has"])
    return F.when(whole, F.transform(ordered, lambda x: x["s"]))


def rerank(hits: DataFrame, scorer: Scorer, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """hits with rerank_score, which becomes final_score, and new ranks; ties keep their order. Empty queries are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = pd.Series(0.0, index=batch.index)
            for query, part in batch.groupby(query_col, sort=False, dropna=False):
                if not isinstance(query, str) or not query.strip():
                    raise ValueError("a query to rerank for must not be empty")
                got = list(scorer.score(query, part[text_col].tolist()))
                if len(got) != len(part):
                    raise ValueError("every document must be scored")
                scores[part.index] = got
            yield batch.assign(rerank_score=scores)

    kept = hits.drop("rerank_score")
    schema = StructType([*kept.schema.fields, StructField("rerank_score", DoubleType())])
    scored = kept.mapInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("__rank", F.row_number().over(order)).withColumn("rank", F.col("__rank")).withColumn("final_score", F.col("rerank_score")).drop("__rank")


def diversify(hits: DataFrame, k: int, per_paper: int | None = None) -> DataFrame:
    """In rank order, at most per_paper hits of a paper and k in all, ranked anew."""
    if per_paper is not None and per_paper < 1:
        raise ValueError("the cap per paper must be at least 1")
    if per_paper:
        hits = hits.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("rank"))).where(F.col("__n") <= per_paper).drop("__n")
    return top_by(hits, k, "rank", rank="__rank").withColumn("rank", F.col("__rank")).drop("__rank")


def unique_papers(hits: DataFrame, limit: int) -> DataFrame:
    """The first hit of every paper, at most `limit` of a query, with their ranks as they were."""
    return collapse_papers(hits, limit).drop("paper_rank")


def collapse_papers(hits: DataFrame, limit: int) -> DataFrame:
    """unique_papers with paper_rank from 1."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    first = hits.withColumn("__n", F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("rank"))).where("__n = 1").drop("__n")
    return top_by(first, limit, "rank", rank="paper_rank")

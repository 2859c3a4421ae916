"""The three flows: build a corpus, ask questions, evaluate retrieval, each for many queries at once.

What a model service makes (vectors of queries, scores, answers) is stored once in the shared folder and read from there, however many frames use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.functions import text as T
from paperlane.operators import chunking, embedding, evidence, lexical, metrics, ranking, vector
from paperlane.plans.config import PROBES, AskConfig, EvalConfig, RetrievalConfig
from paperlane.plans.stored import stored

PAYLOAD = ("chunk_id", "paper_id", "title", "section_path", "living_review_categories", "chunk_type", "chunk_index", "token_count", "text", "source_url")


def build_chunks(papers: DataFrame, parsed: DataFrame, max_tokens: int = chunking.MAX_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) from parsed paragraphs and their papers' metadata; the title of the source comes first."""
    errors = parsed.where(F.col("error").isNotNull()).select("paper_id", F.lit("parse_failed").alias("status"), "error")
    rows = parsed.where(F.col("error").isNull()).drop("error").withColumnRenamed("title", "tex_title").join(papers, "paper_id", "left")
    rows = rows.withColumn("title", F.coalesce("tex_title", "title")).drop("tex_title")
    return chunking.chunk_paragraphs(rows, max_tokens), errors


def index_chunks(chunks: DataFrame, embedder: embedding.Embedder) -> DataFrame:
    """The chunk table that searches read: search_document and embedding beside the payload."""
    rows = embedding.embedding_rows(chunks, embedder)
    return rows.withColumn("search_document", T.render_lexical(F.col("title"), F.col("section_path"), F.col("living_review_categories"), F.col("text")))


def celled_index(index: DataFrame, cells: int) -> tuple[DataFrame, list[list[float]]]:
    """(the index with the cell of each vector, to be written partitioned by it; the cells' centroids) for inexact search."""
    centroids = vector.fit_cells(index, cells)
    return vector.assign_cells(index, centroids), centroids


def search(queries: DataFrame, index: DataFrame, config: RetrievalConfig, centroids: list[list[float]] | None = None) -> DataFrame:
    """query_id, query, rank, payload, final_score and the scores it comes from; candidate_k hits a query. Wide columns join last.

    With config.exact off, vectors are sought in config.probes cells a query; that takes an index with cells and its centroids (celled_index).
    """
    empty = F.lit(None).cast("double")
    if config.uses_vector:
        if "embedding" not in queries.columns:
            raise ValueError("vector search needs embedded queries")
        asked = queries.withColumnRenamed("embedding", "query_embedding")
        if config.exact:
            near = vector.vector_search(asked, index, config.candidate_k)
        elif centroids is None or "cell" not in index.columns:
            raise ValueError("inexact search needs an index with cells, and their centroids")
        else:
            near = vector.probe_search(asked, index, centroids, config.candidate_k, min(config.probes or PROBES, len(centroids)))
    if config.mode == "vector":
        hits = near.withColumns({"final_score": F.col("vector_score"), "lexical_score": empty, "rrf_score": empty})
    else:
        words = lexical.web_search(queries, index, config.lexical_k, analyser=config.analyser)
        if config.mode == "lexical":
            hits = words.withColumns({"final_score": F.col("lexical_score"), "vector_score": empty, "rrf_score": empty})
        else:
            hits = ranking.fuse(near, words, config.candidate_k, config.rrf_k).withColumn("final_score", F.col("rrf_score"))
    slim = hits.select("query_id", "chunk_id", "rank", "final_score", "vector_score", "lexical_score", "rrf_score")
    return slim.join(index.select(*PAYLOAD), "chunk_id").join(queries.select("query_id", "query"), "query_id")


def retrieve(queries: DataFrame, index: DataFrame, config: RetrievalConfig, scorer: ranking.Scorer | None = None, centroids: list[list[float]] | None = None) -> DataFrame:
    """Search, then rerank if a scorer is given, then diversify to final_k."""
    hits = search(queries, index, config, centroids)
    return ranking.diversify(ranking.rerank(hits, scorer) if scorer else hits, config.final_k, config.per_paper)


def ask(questions: DataFrame, index: DataFrame, embedder: embedding.Embedder, scorer: ranking.Scorer, generator: evidence.Generator, config: AskConfig = AskConfig(), centroids: list[list[float]] | None = None) -> DataFrame:
    """questions (query_id, query) to query_id, answer, valid, context, sources; questions without hits give no row.

    Each question is embedded once, each hit scored once, each answer asked for once (and once more if it cites nothing valid).
    """
    queries = stored(embedding.embed_queries(questions, embedder), "questions")
    hits = stored(retrieve(queries, index, config.retrieval, scorer, centroids), "hits")
    ranked = evidence.rank_evidence(hits, evidence.select_evidence(hits, index.select(*PAYLOAD), config.window))
    contexts = stored(evidence.pack_context(ranked, config.budget), "contexts")
    answers = stored(evidence.generate(contexts.join(questions.select("query_id", "query"), "query_id"), generator), "answers")
    lines = evidence.format_sources(ranked).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_number", "line"))), lambda x: x["line"]), "\n").alias("sources"))
    return answers.join(contexts.select("query_id", "context"), "query_id").join(lines, "query_id")


def evaluate(queries: DataFrame, index: DataFrame, config: EvalConfig = EvalConfig(), scorer: ranking.Scorer | None = None, centroids: list[list[float]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, metrics by query and k, rank metrics). Papers are made unique before the costly reranking."""
    queries = stored(queries, "queries")
    hits = search(queries, index, config.retrieval, centroids)
    if scorer:
        hits = ranking.rerank(ranking.unique_papers(hits, config.rerank_papers), scorer)
    candidates = stored(ranking.collapse_papers(hits, config.papers), "candidates")
    return candidates, metrics.query_metrics(queries, candidates, config.cuts), metrics.rank_metrics(queries, candidates)

"""What plans leave behind: manifests, parsed papers, embeddings with their settings, reports. Tables go to folders, small records to one file."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.operators import metrics
from paperlane.sources import files


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One file in any file system that Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return files.read_text(spark, path).first()["value"]


def as_json(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_manifest(manifest: DataFrame, folder: str) -> None:
    """manifest.jsonl (a folder) and summary.json: rows in all and by status."""
    manifest.write.mode("overwrite").json(f"{folder}/manifest.jsonl")
    counts = {r["status"]: r["n"] for r in files.status_summary(manifest).collect()}  # a few statuses
    put_text(manifest.sparkSession, f"{folder}/summary.json", as_json({"total": sum(counts.values()), "status_counts": counts}))


def write_category_index(paths: DataFrame, folder: str) -> None:
    """bib_key and living_review_categories of every entry, sorted, as JSON lines."""
    paths.select("bib_key", "living_review_categories").sort("bib_key").write.mode("overwrite").json(f"{folder}/categories.jsonl")


def write_parsed(papers: DataFrame, chunks: DataFrame, errors: DataFrame, folder: str, inspected: int = 10) -> None:
    """papers, chunks and parse errors as JSON lines, and the first papers as Markdown to look at."""
    for name, table in (("papers", papers), ("chunks", chunks), ("parse_errors", errors)):
        table.write.mode("overwrite").json(f"{folder}/{name}.jsonl")
    shown = files.inspection(chunks, inspected).orderBy("paper_id").collect()  # `inspected` papers
    put_text(chunks.sparkSession, f"{folder}/inspection.md", "\n\n".join(r["markdown"] for r in shown) + "\n")


def safe_name(model: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "-", model).strip("-") or "embeddings"


def write_embeddings(rows: DataFrame, folder: str, settings: dict) -> dict:
    """rows (with embedding) as Parquet and config.json: the settings, the number of rows and the dimension. All vectors must be there and of one length."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    record = settings | checked_vectors(spark.read.parquet(f"{folder}/rows"))
    put_text(spark, f"{folder}/config.json", as_json(record))
    return record


def checked_vectors(rows: DataFrame) -> dict:
    n, vectors, low, high = rows.agg(F.count("*"), F.count("embedding"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if vectors != n:
        raise ValueError(f"{n} rows for {vectors} vectors")
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    return {"rows": n, "dimension": high or 0}


def load_embeddings(spark: SparkSession, folder: str, chunks: DataFrame) -> tuple[DataFrame, dict]:
    """(rows joined to their chunks, settings). The table must hold what config.json says, and every row a chunk."""
    record, rows = json.loads(get_text(spark, f"{folder}/config.json")), spark.read.parquet(f"{folder}/rows")
    if (found := checked_vectors(rows)) != {k: record[k] for k in found}:
        raise ValueError(f"config.json tells of {record}, the table holds {found}")
    return files.join_vectors(rows, chunks), record


def write_query_vectors(queries: DataFrame, path: str) -> None:
    """query_id, query and embedding, as Parquet."""
    queries.select("query_id", "query", "embedding").write.mode("overwrite").parquet(path)


def write_report(folder: str, settings: dict, queries: DataFrame, candidates: DataFrame, per_query: DataFrame, ranks: DataFrame, papers: DataFrame | None = None, shown: int = 10) -> dict:
    """retrieval_metrics.json and .md; papers (paper_id, title) name what was found. A labelled set is small: its figures are what the driver reads."""
    spark = queries.sparkSession
    by_k = [r.asDict() for r in metrics.aggregate_metrics(per_query).orderBy("k").collect()]
    means = metrics.aggregate_ranks(queries, ranks).first().asDict()
    titled = candidates.where(F.col("paper_rank") <= shown).select("query_id", "paper_rank", "paper_id")
    missing = ranks.select("query_id", F.explode("missing").alias("paper_id"))
    if papers is not None:
        names = papers.groupBy("paper_id").agg(F.first("title").alias("title"))
        titled, missing = titled.join(names, "paper_id", "left"), missing.join(names, "paper_id", "left")
    else:
        titled, missing = (t.withColumn("title", F.lit(None).cast("string")) for t in (titled, missing))
    top = titled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("paper_rank", "paper_id", "title"))).alias("top"))
    gone = missing.groupBy("query_id").agg(F.collect_list(F.struct("paper_id", "title")).alias("gone"))
    at = per_query.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "n_targets", "recall", "precision", "hit", "non_target"))).alias("at"))
    expected = F.col("expected_result") if "expected_result" in queries.columns else F.lit(None).cast("string")
    rows = queries.select("query_id", "query", expected.alias("expected"), F.col("relevant_paper_ids").alias("targets"))
    for part in (at, ranks.drop("missing"), top, gone):
        rows = rows.join(part, "query_id", "left")
    details = [r.asDict(recursive=True) for r in rows.orderBy("query_id").collect()]
    record = {"config": settings, "aggregate": {"by_k": by_k, **means}, "queries": details}
    put_text(spark, f"{folder}/retrieval_metrics.json", as_json(record))
    put_text(spark, f"{folder}/retrieval_metrics.md", metrics.render_report(by_k, means, details))
    return record

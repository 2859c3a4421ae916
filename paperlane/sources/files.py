"""Readers, writers and table maintenance: manifests, JSON lines, source archives, upserts."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARSEABLE = ("downloaded_and_extracted", "already_extracted")
MANIFEST = (
    "bib_key string, entry_type string, title string, authors string, year string, arxiv_id string, primary_class string, source_url string, status string, "
    "living_review_categories array<array<string>>, source_path string, extracted_path string, error string"
)
CHUNK = (
    "chunk_id string, paper_id string, bib_key string, title string, authors string, year string, primary_class string, source_url string, main_tex_path string, "
    "living_review_categories array<array<string>>, section_path array<string>, chunk_index int, chunk_type string, text string, token_count int, paragraph_ids array<string>"
)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """value: each file as one text."""
    return spark.read.text(path, wholetext=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """JSON lines with a stated schema; blank lines are skipped. A limit is taken in the order of a column."""
    rows = spark.read.schema(schema).json(path)
    return rows.orderBy(order or rows.columns[0]).limit(limit) if limit is not None else rows


def parseable(manifest: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows with sources to parse; existing (extracted_path): paths that are there."""
    rows = manifest.where(F.col("status").isin(*PARSEABLE) & (F.coalesce("extracted_path", F.lit("")) != ""))
    return rows.join(existing, "extracted_path", "left_semi") if existing is not None else rows


def status_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def new_entries(entries: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Entries not ingested before: those without a usable manifest row."""
    return entries if force else entries.join(parseable(manifest).select("bib_key"), "bib_key", "left_anti")


def source_kind(content: Column) -> Column:
    """pdf, zip, tar (compressed or not, with the ustar mark or without), gzip or tex."""

    @F.pandas_udf("string")
    def kinds(data: pd.Series) -> pd.Series:
        return data.map(kind_of)

    return kinds(content)


def kind_of(data: bytes | None) -> str | None:
    if data is None:
        return None
    data = bytes(data)
    if data.startswith(b"%PDF"):
        return "pdf"
    if zipfile.is_zipfile(io.BytesIO(data)):
        return "zip"
    try:
        if tarfile.is_tarfile(io.BytesIO(data)):
            return "tar"
    except (EOFError, OSError, zlib.error):  # a compressed file that breaks off
        pass
    return "gzip" if data.startswith(b"\x1f\x8b") else "tex"


def _safe(name: str) -> bool:
    return not name.startswith("/") and ".." not in name.split("/")


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the files in a source: archives are read in memory, names that leave the archive are refused."""
    kind = kind_of(data)
    if kind == "pdf":
        return
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    if not _safe(info.filename):
                        raise ValueError(f"unsafe path in archive: {info.filename}")
                    yield info.filename, z.read(info)
        return
    if kind != "tar":
        yield "main.tex", gzip.decompress(data) if kind == "gzip" else data
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t.getmembers():
            if not _safe(m.name):
                raise ValueError(f"unsafe path in archive: {m.name}")
            if m.isfile():
                yield m.name, t.extractfile(m).read()


def unpack(sources: DataFrame) -> DataFrame:
    """sources (paper_id, content) to files (paper_id, path, content, error); nothing is written, failures are rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for paper, data in zip(batch["paper_id"], batch["content"]):
                try:
                    rows = [(paper, path, text.decode("utf-8", "replace"), None) for path, text in members(bytes(data))]
                except Exception as e:  # one source's failure is data
                    rows = [(paper, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["paper_id", "path", "content", "error"])

    return sources.select("paper_id", "content").mapInPandas(run, "paper_id string, path string, content string, error string")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id", unique: str | None = None, order: str | None = None) -> DataFrame:
    """existing with rows of equal key replaced and new ones added; of equal keys in incoming the last wins, by `order` or by `unique`, and without
    either (rows have no order of their own) that with the largest hash, so that the same rows give the same result.

    Write the result to a new path. `unique`: a column that must not repeat over keys; repeats are refused.
    """
    by = [F.col(c).desc() for c in (order, unique) if c] + [F.xxhash64(*incoming.columns).desc()]
    incoming = incoming.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("__n = 1").drop("__n")
    out = incoming.unionByName(existing.join(incoming.select(key), key, "left_anti"))
    if unique:
        times = F.count("*").over(Window.partitionBy(unique))
        out = out.withColumn("__times", times).where(F.when(F.col("__times") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{unique} repeats: "), F.col(unique).cast("string"))).cast("boolean"))).drop("__times")
    return out


def join_vectors(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embedding rows with their chunks; of chunks with equal ids the last index counts; a row without a chunk is refused."""
    last = chunks.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in chunks.columns if c != "chunk_id"]), "chunk_index").alias("c"))
    out = rows.join(last, "chunk_id", "left")
    found = F.when(F.col("c").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no chunk "), F.col("chunk_id"))).cast("boolean"))
    taken = [F.col(f"c.{c}").alias(c) for c in chunks.columns if c not in rows.columns]
    return out.where(found).select(*rows.columns, *taken)


def write_index(chunks: DataFrame, path: str, files: int = 8) -> None:
    """The chunk table, sorted by paper within files, so that a paper's chunks are pruned to."""
    chunks.repartition(files, "paper_id").sortWithinPartitions("paper_id", "chunk_index").write.mode("overwrite").parquet(path)


def inspection(chunks: DataFrame, papers: int = 10) -> DataFrame:
    """paper_id, markdown of the first papers."""
    first = chunks.select("paper_id").distinct().orderBy("paper_id").limit(papers)
    line = F.format_string("### %s (%d tokens)\n\n%s", F.col("chunk_id"), F.col("token_count"), F.col("text"))
    rows = chunks.join(first, "paper_id", "left_semi").groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", line.alias("line")))).alias("lines"))
    return rows.select("paper_id", F.concat(F.lit("## "), F.col("paper_id"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")).alias("markdown"))

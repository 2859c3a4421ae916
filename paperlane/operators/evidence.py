"""Evidence for answers: which chunks of the found papers, in what order, how many fit, and whether an answer cites them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.functions import text as T

#: White space of any kind around a text.
SURROUNDING = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
LEAST_BUDGET, UNRANKED = 500, 10_000


def is_abstract(chunk_type: Column, section_path: Column) -> Column:
    return (chunk_type == "abstract") | F.coalesce(F.lower(F.trim(F.get(section_path, F.lit(0)))) == "abstract", F.lit(False))


def select_evidence(hits: DataFrame, chunks: DataFrame, window: int = 0) -> DataFrame:
    """query_id and the chunks of its papers that are abstracts or within `window` of a hit's chunk_index.

    hits: query_id, paper_id, chunk_index, rank. Papers meet their chunks by paper_id, each with the places of its hits, so that only what is near is passed on; the result is dealt by query.
    """
    if window < 0:
        raise ValueError("the window must not be negative")
    papers = hits.groupBy("query_id", "paper_id").agg(F.collect_set("chunk_index").alias("__seeds"))
    abstract = (F.col("chunk_type") == "abstract") | F.coalesce(F.array_contains("section_path", "Abstract"), F.lit(False))
    near = F.col("query_id").isNotNull() & F.exists("__seeds", lambda x: F.col("chunk_index").between(x - window, x + window))
    owned = chunks.join(papers, "paper_id").where(abstract | (~abstract & near)).drop("__seeds")
    return owned.repartition("query_id").dropDuplicates(["query_id", "chunk_id"])


def rank_evidence(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """evidence with source_number (papers in order of their first hit), is_abstract (the paper's first) and position of passages.

    A query's papers and hits are few and meet its evidence as arrays, so that texts are sent by query alone.
    """
    papers = hits.groupBy("query_id", "paper_id").agg(F.min("rank").alias("first_rank"))
    papers = papers.withColumn("source_number", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank", "paper_id"))).drop("first_rank")
    ranks = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("hit_rank"))
    listed = lambda df, name: df.groupBy("query_id").agg(F.collect_list(F.struct(*df.columns[1:])).alias(name))
    found = lambda name, key: F.get(F.filter(name, lambda x: x[key] == F.col(key)), F.lit(0))
    rows = evidence.join(listed(papers, "__papers").join(listed(ranks, "__ranks"), "query_id"), "query_id")
    rows = rows.withColumns({"source_number": found("__papers", "paper_id")["source_number"], "hit_rank": found("__ranks", "chunk_id")["hit_rank"]})
    rows = rows.where(F.col("source_number").isNotNull()).drop("__papers", "__ranks")
    paper = Window.partitionBy("query_id", "paper_id")
    rows = rows.withColumn("like_abstract", is_abstract(F.col("chunk_type"), F.col("section_path")))
    first = F.min(F.when(F.col("like_abstract"), F.struct("chunk_index", "chunk_id"))).over(paper)
    rows = rows.withColumn("is_abstract", F.coalesce(first["chunk_id"] == F.col("chunk_id"), F.lit(False)))
    order = paper.orderBy("is_abstract", F.coalesce("hit_rank", F.lit(UNRANKED)), "chunk_index", "chunk_id")
    return rows.withColumn("position", F.when(~F.col("is_abstract"), F.row_number().over(order))).drop("like_abstract")


def header(source: Column, title: Column, paper_id: Column) -> Column:
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("(title unavailable)"))
    return F.concat(F.lit("[SOURCE "), source.cast("string"), F.lit("]\nPaper: "), named, F.lit("\narXiv: "), paper_id)


def pack_context(ranked: DataFrame, budget: int) -> DataFrame:
    """query_id, context, used, kept (chunk ids): all abstracts, then passages in order as far as each fits; one that does not fit is skipped.

    The evidence of a query is bounded by its hits, so the fold is over one small array a query.
    """
    if budget < LEAST_BUDGET:
        raise ValueError(f"the budget must be at least {LEAST_BUDGET}")
    paper = ranked.groupBy("query_id", "source_number").agg(
        F.first("paper_id").alias("paper_id"), F.first("title").alias("title"),
        F.max(F.when(F.col("is_abstract"), F.col("text"))).alias("abstract"),
        F.array_sort(F.collect_list(F.when(~F.col("is_abstract"), F.struct("position", "chunk_id", "section_path", "text")))).alias("passages"),
    )
    must = F.concat(header(F.col("source_number"), F.col("title"), F.col("paper_id")), F.lit("\nAbstract:\n"), F.coalesce(F.nullif("abstract", F.lit("")), F.lit("(Abstract unavailable in corpus.)")), F.lit("\n"))

    def block(p: Column) -> Column:
        path = F.coalesce(F.nullif(T.join_path(p["section_path"]), F.lit("")), F.lit("(section unavailable)"))
        return F.concat(F.lit("Passage, section "), path, F.lit(":\n"), p["text"], F.lit("\n"))

    paper = paper.select("query_id", "source_number", must.alias("must"), F.transform("passages", lambda p: F.struct(p["chunk_id"].alias("id"), block(p).alias("block"))).alias("passages"))
    query = paper.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_number", "must", "passages"))).alias("papers"))
    needed = F.aggregate("papers", F.lit(0), lambda n, p: n + T.estimate_answer_tokens(p["must"]))
    priced = lambda p, x: F.struct(p["source_number"].alias("n"), x["id"].alias("id"), x["block"].alias("block"), T.estimate_answer_tokens(x["block"]).alias("cost"))
    every = F.flatten(F.transform("papers", lambda p: F.transform(p["passages"], lambda x: priced(p, x))))
    start = F.struct(needed.alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= budget
        return F.struct(F.when(fits, s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.when(fits, F.array_append(s["kept"], x["id"])).otherwise(s["kept"]).alias("kept"))

    packed = query.withColumn("packed", F.when(needed > budget, F.raise_error(F.lit("the abstracts alone exceed the budget"))).otherwise(F.aggregate(every, start, step)))
    taken = lambda p: F.transform(F.filter(p["passages"], lambda x: F.array_contains(F.col("packed.kept"), x["id"])), lambda x: x["block"])
    text = F.transform("papers", lambda p: F.regexp_replace(F.array_join(F.concat(F.array(p["must"]), taken(p)), "\n"), SURROUNDING, ""))
    return packed.select("query_id", F.array_join(text, "\n\n").alias("context"), F.col("packed.used").alias("used"), F.col("packed.kept").alias("kept"))


def format_sources(ranked: DataFrame) -> DataFrame:
    """query_id, source_number, line: title, id, the distinct section paths in order, and the address of every paper."""
    path = T.join_path(F.col("section_path"))
    named = F.coalesce(F.nullif(F.first("title"), F.lit("")), F.first("paper_id"))
    rows = ranked.groupBy("query_id", "source_number").agg(named.alias("name"), F.first("paper_id").alias("id"), F.array_join(F.array_sort(F.array_distinct(F.collect_list(F.when(path != "", path)))), "; ").alias("sections"))
    line = F.concat(F.lit("["), F.col("source_number").cast("string"), F.lit("] "), F.col("name"), F.lit(" (arXiv:"), F.col("id"), F.lit(") — "), F.col("sections"), F.lit("\n    https://arxiv.org/abs/"), F.col("id"))
    return rows.select("query_id", "source_number", line.alias("line"))


class Generator(Protocol):
    """Answers a list of (role, content) messages; must be picklable."""

    def complete(self, messages: list[tuple[str, str]]) -> str: ...


class ExtractiveGenerator:
    """Offline stand-in: the first sentence of the first source, cited."""

    def complete(self, messages: list[tuple[str, str]]) -> str:
        body = messages[-1][1].partition("Abstract:\n")[2].strip().split("\n")[0]
        return f"{body.split('. ')[0].strip() or 'No evidence'} [1]"


def generate(contexts: DataFrame, generator: Generator, system: str = "Answer from the sources and cite them as [n].") -> DataFrame:
    """query_id, answer, valid: one call, and one more asking for valid citations if the first has none."""
    import re

    def complete(query: str, context: str) -> tuple[str, bool]:
        allowed = {int(n) for n in re.findall(r"\[SOURCE (\d+)\]", context)}
        cited = lambda a: (c := {int(n) for n in re.findall(r"\[(\d+)\]", a)}) != set() and c <= allowed
        messages = [("system", system), ("user", f"Question: {query}\n\n{context}")]
        answer = generator.complete(messages)
        if not cited(answer):
            again = f"Rewrite the answer with inline citations. Use only these numbers: {', '.join(f'[{n}]' for n in sorted(allowed))}."
            answer = generator.complete([*messages, ("assistant", answer), ("user", again)])
        if not answer.strip():
            raise ValueError("the generator gave no text")
        return answer, cited(answer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [complete(q, c) for q, c in zip(batch["query"], batch["context"])]
            yield pd.DataFrame({"query_id": batch["query_id"], "answer": [a for a, _ in got], "valid": [v for _, v in got]})

    kind = contexts.schema["query_id"].dataType.simpleString()
    return contexts.select("query_id", "query", "context").mapInPandas(run, f"query_id {kind}, answer string, valid boolean")

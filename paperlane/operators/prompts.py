"""Prompts for a reranker that answers yes or no: token budgets, checks of a request, usage.

A prompt is the prefix, the instruction, the query and the head of the document, cut to what the budget leaves beside the suffix, and the suffix, which is always whole.
The cut is made in tokens, by a tokenizer file, so a document ends wherever the budget does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

# The text around a reranker's prompt, and its default instruction.
INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"
SYSTEM = 'Judge whether the Document meets the requirements based on the Query and the Instruct provided. Note that the answer can only be "yes" or "no".'
PREFIX = f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\n"
SUFFIX = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
BODY = "<Instruct>: {instruction}\n\n<Query>: {query}\n\n<Document>: {document}"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class Prompting:
    """How prompts are made; `model` is the model that is loaded."""

    tokenizer: str
    model: str = ""
    max_length: int = 1024
    instruction: str = INSTRUCTION
    prefix: str = PREFIX
    suffix: str = SUFFIX

    def tokens(self, text: str) -> list[int]:
        return _tokenizer(self.tokenizer).encode(text, add_special_tokens=False).ids

    def room(self, requested: int | None = None) -> int:
        """Tokens that are left beside the suffix; a request may ask for fewer than the model takes, not for more."""
        if requested is not None and requested < 1:
            raise ValueError("the requested prompt length must be at least 1")
        most = min(requested or self.max_length, self.max_length)
        left = most - len(self.tokens(self.suffix))
        if left < 1:
            raise ValueError(f"a prompt of {most} tokens is too short for the suffix")
        return left


def check_request(prompting: Prompting, model: str | None = None, top_n: int | None = None) -> None:
    """Refuses a request for another model than the one loaded, and a top_n below 1."""
    if model and model != prompting.model:
        raise ValueError(f"the model loaded is {prompting.model!r}, not {model!r}")
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be at least 1")


def assemble(hits: DataFrame, prompting: Prompting, requested: int | None = None, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """hits with prompt_ids, and whether the document was cut. Empty queries are refused; null documents are empty."""
    room = prompting.room(requested)
    place, kept = hits.columns, hits.drop("prompt_ids", "cut")
    schema = StructType([*kept.schema.fields, StructField("prompt_ids", ArrayType(IntegerType())), StructField("cut", BooleanType())])
    if not {query_col, text_col} <= set(place):
        raise ValueError(f"prompts need the columns {query_col} and {text_col}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end = _tokenizer(prompting.tokenizer), prompting.tokens(prompting.suffix)
        for batch in batches:
            if not all(isinstance(q, str) and q.strip() for q in batch[query_col]):
                raise ValueError("a query to rerank for must not be empty")
            texts = [prompting.prefix + BODY.format(instruction=prompting.instruction, query=q, document=d or "") for q, d in zip(batch[query_col], batch[text_col])]
            ids = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            yield batch.assign(prompt_ids=[i[:room] + end for i in ids], cut=[len(i) > room for i in ids])

    return kept.mapInPandas(run, schema)


def usage(prompts: DataFrame) -> DataFrame:
    """query_id, prompt_tokens, completion_tokens (one a document), total_tokens."""
    n = F.sum(F.size("prompt_ids")).cast("long")
    return prompts.groupBy("query_id").agg(n.alias("prompt_tokens"), F.count("*").alias("completion_tokens"), (n + F.count("*")).alias("total_tokens"))


def ranked(scored: DataFrame, top_n: int | None = None) -> DataFrame:
    """scored (query_id, rank, rerank_score) ranked anew, ties in their order; with top_n the first so many. A query with fewer documents than top_n is refused."""
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    out = scored.withColumn("__rank", F.row_number().over(order))
    if top_n is not None:
        if top_n < 1:
            raise ValueError("top_n must be at least 1")
        enough = F.when(F.count("*").over(Window.partitionBy("query_id")) >= top_n, F.lit(True)).otherwise(F.raise_error(F.lit("top_n exceeds the number of documents")).cast("boolean"))
        out = out.withColumn("__enough", enough).where(F.col("__enough") & (F.col("__rank") <= top_n)).drop("__enough")
    return out.withColumn("rank", F.col("__rank")).drop("__rank")

"""Clients of model services and of source archives over HTTP. They keep only settings, so they travel to workers.

The JSON shapes are those of OpenAI-compatible servers: /embeddings, /rerank and /chat/completions.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from paperlane.plans.config import ServiceConfig
from paperlane.sources.bibtex import read_bibliography
from paperlane.sources.categories import read_categories
from paperlane.sources.files import kind_of, members, read_text


class ServiceError(RuntimeError):
    """A service did not answer, or not in the shape expected."""


def post_json(url: str, payload: dict, key: str | None = None, timeout: float = 120.0) -> dict:
    headers = {"Content-Type": "application/json", "Accept": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(payload).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read().decode())
    except urllib.error.HTTPError as e:
        raise ServiceError(f"{url} answered {e.code}: {e.read().decode(errors='replace')}") from e
    except urllib.error.URLError as e:
        raise ServiceError(f"{url} did not answer: {e.reason}") from e


@dataclass(frozen=True)
class Client:
    service: ServiceConfig
    key: str | None = None
    timeout: float = 120.0

    def post(self, endpoint: str, payload: dict) -> dict:
        return post_json(self.service.url.rstrip("/") + "/" + endpoint.lstrip("/"), payload, self.key, self.timeout)


class EmbeddingService(Client):
    """An Embedder; the service's vectors are put in the order of their index."""

    def embed(self, texts: list[str]) -> np.ndarray:
        out: list[list[float]] = []
        for k in range(0, len(texts), self.service.batch):
            payload = {"model": self.service.model, "input": texts[k : k + self.service.batch]}
            if self.service.max_tokens is not None:
                payload |= {"truncate_prompt_tokens": self.service.max_tokens, "truncation_side": "right"}
            rows = sorted(self.post("embeddings", payload)["data"], key=lambda x: x.get("index", 0))
            if len(rows) != len(payload["input"]):
                raise ServiceError(f"{len(rows)} vectors for {len(payload['input'])} texts")
            out += [r["embedding"] for r in rows]
        return np.asarray(out, np.float32)


class RerankService(Client):
    """A Scorer; every document must get a score."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        body = self.post("rerank", {"model": self.service.model, "query": query, "documents": documents, "top_n": len(documents)})
        rows = body.get("results") or body.get("data")
        if not isinstance(rows, list):
            raise ServiceError("no results in the answer")
        found: dict[int, float] = {}
        for n, row in enumerate(rows):
            at, value = int(row.get("index", row.get("corpus_id", n))), row.get("relevance_score")
            value = row.get("score") if value is None else value
            if not 0 <= at < len(documents) or value is None:
                raise ServiceError(f"a result without a document or a score: {row}")
            found[at] = float(value)
        if len(found) != len(documents):
            raise ServiceError(f"no score for documents {sorted(set(range(len(documents))) - set(found))}")
        return [found[n] for n in range(len(documents))]


@dataclass(frozen=True)
class ChatService(Client):
    """A Generator; greedy decoding."""

    answer_tokens: int = 1200

    def complete(self, messages: list[tuple[str, str]]) -> str:
        payload = {"model": self.service.model, "messages": [{"role": r, "content": c} for r, c in messages], "max_tokens": self.answer_tokens, "temperature": 0.0, "top_p": 1.0, "top_k": 20, "presence_penalty": 0.0}
        choices = self.post("chat/completions", payload).get("choices") or [{}]
        text = (choices[0].get("message") or {}).get("content")
        if not isinstance(text, str) or not text.strip():
            raise ServiceError("no text in the answer")
        return text.strip()


def fetch(url: str, agent: str = "paperlane", timeout: float = 60.0) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
        return answer.read()


def text_from(spark: SparkSession, path: str | None = None, url: str | None = None, agent: str = "paperlane", timeout: float = 60.0) -> DataFrame:
    """value: one text, of the file if there is one, else from the address; the address is asked by a task, whenever the frame is read."""
    if path is not None:
        return read_text(spark, path)
    if not url:
        raise ValueError("neither a file nor an address is given")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"value": [fetch(u, agent, timeout).decode("utf-8") for u in batch["url"]]})

    return spark.createDataFrame([(url,)], "url string").mapInPandas(run, "value string")


def load_bibliography(spark: SparkSession, path: str | None = None, url: str | None = None, agent: str = "paperlane") -> DataFrame:
    """The entries of a bibliography, from a file or, without one, from an address."""
    return read_bibliography(text_from(spark, path, url, agent)).drop("value")


def load_categories(spark: SparkSession, path: str | None = None, url: str | None = None, agent: str = "paperlane") -> DataFrame:
    """The rows of a category file, from a file or, without one, from an address."""
    return read_categories(text_from(spark, path, url, agent)).drop("value")


STATUSES = "paper_id string, source_url string, status string, content binary, error string"


def download_sources(entries: DataFrame, done: DataFrame | None = None, lanes: int = 1, pause: float = 3.0, agent: str = "paperlane", timeout: float = 120.0) -> DataFrame:
    """entries (paper_id, source_url) to paper_id, source_url, status, content, error. Failures are rows and stop nothing.

    `done` (paper_id): sources that are there already, not fetched again and given as already_extracted. `lanes` tasks fetch, each with a
    pause between requests. Write the result at once: every reading of it fetches again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, (paper, url) in enumerate(zip(batch["paper_id"], batch["source_url"])):
                time.sleep(pause if n else 0)
                data, error = None, None
                try:
                    data = fetch(url, agent, timeout)
                    kind = kind_of(data)
                    if kind != "pdf":
                        list(members(data))  # unsafe and broken archives fail here
                    status = "downloaded_pdf_only" if kind == "pdf" else "downloaded_and_extracted"
                except urllib.error.HTTPError as e:
                    status, error = "download_failed", f"HTTP {e.code}: {e.reason}"
                except Exception as e:  # one source's failure is data
                    status, error, data = "failed", f"{type(e).__name__}: {e}", None
                yield pd.DataFrame([(paper, url, status, data, error)], columns=["paper_id", "source_url", "status", "content", "error"])

    wanted = entries.select("paper_id", "source_url")
    if done is None:
        return wanted.repartition(lanes).mapInPandas(run, STATUSES)
    there = wanted.join(done.select("paper_id"), "paper_id", "left_semi").selectExpr("paper_id", "source_url", "'already_extracted' AS status", "CAST(NULL AS binary) AS content", "CAST(NULL AS string) AS error")
    return wanted.join(done.select("paper_id"), "paper_id", "left_anti").repartition(lanes).mapInPandas(run, STATUSES).unionByName(there)

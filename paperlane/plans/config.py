"""Settings of the pipelines: an explicit value comes before the environment, that before the default."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields, replace
from urllib.parse import urlsplit, urlunsplit

MODES = ("vector", "lexical", "hybrid")
ANALYSERS = ("simple", "english")
#: Cells that an inexact search looks into unless told otherwise.
PROBES = 8


@dataclass(frozen=True)
class RetrievalConfig:
    mode: str = "hybrid"
    candidate_k: int = 50
    final_k: int = 10
    lexical_candidate_k: int | None = None
    rrf_k: int = 60
    exact: bool = True
    probes: int | None = None
    per_paper: int | None = None
    analyser: str = "english"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown retrieval mode: {self.mode}")
        if self.analyser not in ANALYSERS:
            raise ValueError(f"unknown analyser: {self.analyser}")
        if min(self.candidate_k, self.lexical_k, self.rrf_k, self.final_k) < 1:
            raise ValueError("candidate_k, lexical_k, rrf_k and final_k must be at least 1")
        if self.exact and self.probes is not None:
            raise ValueError("probes are for inexact search only")
        if self.probes is not None and self.probes < 1:
            raise ValueError("probes must be at least 1")

    @property
    def lexical_k(self) -> int:
        return self.candidate_k if self.lexical_candidate_k is None else self.lexical_candidate_k

    @property
    def uses_vector(self) -> bool:
        return self.mode != "lexical"


@dataclass(frozen=True)
class AskConfig:
    retrieval: RetrievalConfig = RetrievalConfig(candidate_k=30, final_k=6, per_paper=2)
    budget: int = 5500
    window: int = 0


@dataclass(frozen=True)
class EvalConfig:
    retrieval: RetrievalConfig = RetrievalConfig(mode="vector", candidate_k=300)
    cuts: tuple[int, ...] = (1, 3, 5, 10, 20, 40)
    papers: int = 40
    rerank_papers: int = 100


@dataclass(frozen=True)
class ServiceConfig:
    """A model service: where, which model, how many texts in a request."""

    url: str = "http://localhost:8001/v1"
    model: str = ""
    batch: int = 1
    max_tokens: int | None = None

    @classmethod
    def load(cls, prefix: str, **explicit) -> ServiceConfig:
        env = {f.name: os.environ[f"{prefix}_{f.name.upper()}"] for f in fields(cls) if f"{prefix}_{f.name.upper()}" in os.environ}
        typed = {k: int(v) if k in ("batch", "max_tokens") else v for k, v in env.items()}
        return replace(cls(), **(typed | {k: v for k, v in explicit.items() if v is not None}))

    @classmethod
    def from_artifact(cls, text: str, **explicit) -> ServiceConfig:
        """From the JSON written beside embeddings."""
        known = {f.name for f in fields(cls)}
        return replace(cls(), **({k: v for k, v in json.loads(text).items() if k in known} | explicit))


def valid_identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def redact_url(url: str) -> str:
    """The address without user and password."""
    parts = urlsplit(url)
    if "@" not in parts.netloc:
        return url
    return urlunsplit(parts._replace(netloc="***@" + parts.netloc.rpartition("@")[2]))

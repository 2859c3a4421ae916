"""Clients against a local server, what plans leave behind, and how often models are asked."""

import io
import json
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlane.operators import embedding, evidence, ranking
from paperlane.plans import config, pipelines
from paperlane.plans.stored import drop, stored
from paperlane.sources import services, sinks
from tests.test_engine import index_of


def archive(name):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as t:
        info = tarfile.TarInfo(name)
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    return buffer.getvalue()


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, asked, self.headers.get("Authorization")))
        if self.path.endswith("/embeddings"):
            out = {"data": [{"index": n, "embedding": [float(len(t)), float(n)]} for n, t in enumerate(asked["input"])][::-1]}
        elif self.path.endswith("/rerank"):
            out = {"results": [{"index": n, "relevance_score": -float(n)} for n in range(len(asked["documents"]))][:: -1 if asked["query"] != "few" else -2]}
        else:
            out = {"choices": [{"message": {"content": " An answer [1]. " if asked["model"] else ""}}]}
        self.answer(200 if asked["model"] != "broken" else 500, json.dumps(out).encode())

    def do_GET(self):
        data = {"/tar": archive("a.tex"), "/unsafe": archive("../a.tex"), "/pdf": b"%PDF-1", "/tex": b"plain"}.get(self.path)
        self.answer(200 if data else 404, data or b"")

    def answer(self, code, data):
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.seen = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def settings(server, **more):
    return config.ServiceConfig(url=f"http://127.0.0.1:{server.server_port}/v1/", **{"model": "m", **more})


def test_clients(server):
    embedder = services.EmbeddingService(settings(server, batch=2, max_tokens=9), key="k")
    assert embedder.embed(["a", "bbb", "cc"]).tolist() == [[1, 0], [3, 1], [2, 0]]
    path, asked, key = server.seen[-1]
    assert (path, key, asked) == ("/v1/embeddings", "Bearer k", {"model": "m", "input": ["cc"], "truncate_prompt_tokens": 9, "truncation_side": "right"})
    assert services.RerankService(settings(server)).score("q", ["x", "y", "z"]) == [0, -1, -2]
    assert services.ChatService(settings(server)).complete([("user", "x")]) == "An answer [1]."
    with pytest.raises(services.ServiceError, match="no score"):
        services.RerankService(settings(server)).score("few", ["x", "y"])
    with pytest.raises(services.ServiceError, match="answered 500"):
        services.EmbeddingService(settings(server, model="broken")).embed(["a"])
    with pytest.raises(services.ServiceError, match="no text"):
        services.ChatService(settings(server, model="")).complete([("user", "x")])
    with pytest.raises(services.ServiceError, match="did not answer"):
        services.EmbeddingService(config.ServiceConfig(url="http://127.0.0.1:9/v1", model="m")).embed(["a"])


def test_clients_travel_to_workers(spark, server):
    rows = embedding.embed(spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string"), services.EmbeddingService(settings(server)), normalize=False)
    assert {r.id: list(r.embedding) for r in rows.collect()} == {1: [3, 0], 2: [0, 0]}


def test_downloads(spark, server):
    at = f"http://127.0.0.1:{server.server_port}/"
    entries = spark.createDataFrame([(n, at + n) for n in ("tar", "unsafe", "pdf", "tex", "none", "there")], "paper_id string, source_url string")
    got = {r.paper_id: r for r in services.download_sources(entries, spark.createDataFrame([("there",)], "paper_id string"), pause=0).collect()}
    assert {k: r.status for k, r in got.items()} == {"tar": "downloaded_and_extracted", "unsafe": "failed", "pdf": "downloaded_pdf_only", "tex": "downloaded_and_extracted", "none": "download_failed", "there": "already_extracted"}
    assert bytes(got["tex"].content) == b"plain" and "unsafe" in got["unsafe"].error and "404" in got["none"].error


class Counting:
    """A model that notes each text it is asked about."""

    def __init__(self, path, inner):
        self.path, self.inner = path, inner

    def note(self, what, texts):
        with open(self.path, "a") as f:
            f.writelines(f"{what}\n" for _ in texts)

    def embed(self, texts):
        self.note("embed", texts)
        return self.inner.embed(texts)

    def score(self, query, documents):
        self.note("score", documents)
        return self.inner.score(query, documents)

    def complete(self, messages):
        self.note("complete", [messages])
        return self.inner.complete(messages)


def test_models_are_asked_once(spark, tmp_path):
    index = stored(index_of(spark), "index")
    questions = spark.createDataFrame([("q1", "alpha topic"), ("q2", "gamma topic")], "query_id string, query string")
    path = str(tmp_path / "asked")
    run = config.AskConfig(retrieval=config.RetrievalConfig(mode="vector", candidate_k=5, final_k=3))
    got = pipelines.ask(questions, index, Counting(path, embedding.HashingEmbedder(32)), Counting(path, ranking.OverlapScorer()), Counting(path, evidence.ExtractiveGenerator()), run)
    assert got.count() == 2 and len(got.collect()) == 2
    seen = open(path).read().split()
    assert {w: seen.count(w) for w in set(seen)} == {"embed": 2, "score": 10, "complete": 2}
    labelled = embedding.embed_queries(questions, embedding.HashingEmbedder(32), prompt="").withColumn("relevant_paper_ids", F.array(F.lit("p0")))
    path = str(tmp_path / "scored")
    settings = config.EvalConfig(retrieval=config.RetrievalConfig(mode="vector", candidate_k=12))
    candidates, per, ranks = pipelines.evaluate(labelled, index, settings, Counting(path, ranking.OverlapScorer()))
    assert (candidates.count(), per.count(), ranks.count()) == (6, 12, 2) and len(open(path).read().split()) == 6
    drop(index)
    with pytest.raises(Exception, match="not exist|No such file|FILE_NOT_EXIST"):
        index.collect()


def test_inexact_search(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{n}", "p", v.tolist()) for n, v in enumerate(rng.normal(size=(300, 8)))]
    index = spark.createDataFrame(rows, "chunk_id string, paper_id string, embedding array<double>")
    index = index.select("*", *(F.lit(None).cast("string").alias(c) for c in pipelines.PAYLOAD if c not in index.columns))
    queries = index.where("chunk_id < 'c13'").select(F.col("chunk_id").alias("query_id"), F.lit("q").alias("query"), "embedding")
    found = lambda c, i=index, **k: {(r.query_id, r.chunk_id) for r in pipelines.search(queries, i, c, **k).collect()}
    exact = found(config.RetrievalConfig(mode="vector", candidate_k=5))
    inexact = config.RetrievalConfig(mode="vector", candidate_k=5, exact=False, probes=4)
    with pytest.raises(ValueError, match="cells"):
        found(inexact)
    celled, centroids = pipelines.celled_index(index, 6)
    near = found(inexact, celled, centroids=centroids)
    assert len(near & exact) >= 0.9 * len(exact)
    assert found(config.RetrievalConfig(mode="vector", candidate_k=5, exact=False, probes=6), celled, centroids=centroids) == exact


def test_embeddings_on_disk(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "t"), ("b", 1, "u")], "chunk_id string, chunk_index int, text string")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    folder = str(tmp_path / sinks.safe_name("org/model:1"))
    assert folder.endswith("org-model-1")
    assert sinks.write_embeddings(rows, folder, {"model": "org/model:1"}) == {"model": "org/model:1", "rows": 2, "dimension": 2}
    got, record = sinks.load_embeddings(spark, folder, chunks)
    assert {r.chunk_id: (r.text, list(r.embedding)) for r in got.collect()} == {"a": ("t", [1, 0]), "b": ("u", [0, 1])} and record["model"] == "org/model:1"
    sinks.put_text(spark, f"{folder}/config.json", sinks.as_json(record | {"rows": 3}))
    with pytest.raises(ValueError, match="the table holds"):
        sinks.load_embeddings(spark, folder, chunks)
    for bad, what in (([1.0], "components"), (None, "vectors")):
        with pytest.raises(ValueError, match=what):
            sinks.write_embeddings(rows.unionByName(spark.createDataFrame([("c", bad)], rows.schema)), folder, {})


def test_manifest_and_parsed(spark, tmp_path):
    manifest = spark.createDataFrame([("a", "failed"), ("b", "downloaded_and_extracted"), ("c", "failed")], "bib_key string, status string")
    sinks.write_manifest(manifest, str(tmp_path))
    assert json.loads((tmp_path / "summary.json").read_text()) == {"total": 3, "status_counts": {"failed": 2, "downloaded_and_extracted": 1}}
    assert spark.read.json(str(tmp_path / "manifest.jsonl")).count() == 3
    chunks = spark.createDataFrame([("x:0", "x", 0, 4, "Four words stand here")], "chunk_id string, paper_id string, chunk_index int, token_count int, text string")
    sinks.write_parsed(chunks.select("paper_id"), chunks, chunks.select("paper_id").limit(0), str(tmp_path))
    assert "### x:0 (4 tokens)\n\nFour words" in (tmp_path / "inspection.md").read_text()


def test_report(spark, tmp_path):
    queries = spark.createDataFrame([("q", "Q?", ["a", "c"]), ("n", "N?", [])], "query_id string, query string, relevant_paper_ids array<string>")
    candidates = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("n", "a", 1)], "query_id string, paper_id string, paper_rank int")
    from paperlane.operators import metrics

    per, ranks = metrics.query_metrics(queries, candidates, (1, 2)), metrics.rank_metrics(queries, candidates)
    papers = spark.createDataFrame([("a", "Title A"), ("c", "Title C")], "paper_id string, title string")
    record = sinks.write_report(str(tmp_path), {"retrieval": "vector"}, queries, candidates, per, ranks, papers)
    assert json.loads((tmp_path / "retrieval_metrics.json").read_text())["aggregate"]["mean_mrr"] == record["aggregate"]["mean_mrr"] == 1.0
    text = (tmp_path / "retrieval_metrics.md").read_text()
    for line in ("- Queries with targets: `1`", "| 1 | 0.5000 | 1.0000 | 1.0000 | 1.00 |", "- Targets found: `1/2`", "- 1. `TARGET` a - Title A", "- 2. `MISS` b - (metadata not found)", "- c - Title C", "- First relevant rank: `none`"):
        assert line in text.split("\n")

"""Ranks over many parts: edges are numbered and written once, and no iteration joins names."""

import random

from paperlane.operators import graph
from tests.test_graph import brute


def test_ranks_over_many_parts(spark, monkeypatch):
    for name, value in (("NODES", 7), ("PARTS", 2), ("HOT", 1)):
        monkeypatch.setattr(graph, name, value)
    plans, stored = {}, graph.stored

    def noted(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, tag)

    monkeypatch.setattr(graph, "stored", noted)
    rng = random.Random(2)
    nodes = [f"n{i}" for i in range(50)]
    edges = {(a, b) for a in nodes[:40] for b in rng.sample(nodes, 3) if a != b} | {("n0", x) for x in nodes[1:]}
    got = {r.paper_id: r["rank"] for r in graph.citation_ranks(spark.createDataFrame([(x,) for x in nodes], "paper_id string"), spark.createDataFrame(sorted(edges), "src string, dst string"), tolerance=1e-4).collect()}
    want = brute(nodes, edges)
    assert set(got) == set(nodes) and max(abs(got[x] - want[x]) for x in nodes) < 1e-3
    assert "node" not in plans["ranks"] and "Join" in plans["ranks"]

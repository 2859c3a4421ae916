"""Citations and ranks against plain loops; loaders of bibliographies and categories; limits of embedding; trimmed sources."""

import random
import re
from collections import Counter

import pytest

from paperlane import queries
from paperlane.operators import embedding, evidence, graph, ranking
from paperlane.sources import services

SF = "/root/testdata/sf0.001"


def brute(nodes, edges, damping=0.85, rounds=300):
    out = Counter(s for s, _ in edges)
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        loose = sum(r for n, r in rank.items() if not out[n])
        new = dict.fromkeys(nodes, (1 - damping + damping * loose) / len(nodes))
        for s, d in edges:
            new[d] += damping * rank[s] / out[s]
        rank = new
    return rank


@pytest.mark.parametrize("hot", [1000, 8])
def test_ranks(spark, monkeypatch, hot):
    """A paper that cites all others, one that all others cite, some without citations; with the hot ones broadcast and without."""
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(60)] + ["alone"]
    edges = {(f"n{i}", f"n{rng.randrange(60)}") for i in range(2, 40) for _ in range(3)} | {("n0", f"n{i}") for i in range(1, 60)} | {(f"n{i}", "n1") for i in range(2, 50)}
    edges = {(a, b) for a, b in edges if a != b}
    given = spark.createDataFrame([*edges, *list(edges)[:20], ("n2", "outside"), ("outside", "n2")], "src string, dst string")
    got = {r.paper_id: r["rank"] for r in graph.citation_ranks(spark.createDataFrame([(n, 1) for n in [*nodes, "n1", None]], "paper_id string, x int"), given).collect()}
    want = brute(nodes, edges)
    assert set(got) == set(nodes) and abs(sum(got.values()) - 1) < 1e-9 and max(abs(got[n] - want[n]) for n in nodes) < 1e-8
    counts = {r.paper_id: (r.cites, r.cited) for r in graph.citation_counts(spark.createDataFrame([(n,) for n in nodes], "paper_id string"), spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert counts["alone"] == (0, 0) and counts["n0"][0] == 59 and sum(c for c, _ in counts.values()) == len(edges) == sum(c for _, c in counts.values())


def test_no_papers(spark):
    none = spark.createDataFrame([], "paper_id string, text string, bib_key string")
    assert graph.citation_ranks(none, graph.citations(none, none)).collect() == []
    one = spark.createDataFrame([("a",)], "paper_id string")
    assert [r["rank"] for r in graph.citation_ranks(one, graph.citations(none, none)).collect()] == [1.0]
    for bad in ({"damping": 1.0}, {"tolerance": 0.0}):
        with pytest.raises(ValueError):
            graph.citation_ranks(one, graph.citations(none, none), **bad)


def test_citations(spark):
    texts = spark.createDataFrame([("a", r"\cite{kb, kc} \citep[see][p. 3]{kb,ka} \Citet*{kd} \citation{no}"), ("b", None), ("c", "none"), (None, r"\cite{ka}"), ("d", r"\cite{unknown}")], "paper_id string, text string")
    keys = spark.createDataFrame([("ka", "a"), ("kb", "b"), ("kc", "c"), ("kd", "d"), ("kb2", "b"), ("kn", None)], "bib_key string, paper_id string")
    assert sorted(map(tuple, graph.citations(texts, keys).collect())) == [("a", "b"), ("a", "c"), ("a", "d")]


def test_query_equals_a_loop(spark):
    texts, keys = queries.citing_papers(spark, SF)
    known = {r.bib_key: r.paper_id for r in keys.collect()}
    edges = {(r.paper_id, known[k.strip()]) for r in texts.collect() for m in re.findall(r"\\cite[a-z]*(?:\[[^\]]*\])*\{([^}]*)\}", r.text) for k in m.split(",") if k.strip() in known}
    want, out, into = brute(list(known.values()), edges), Counter(s for s, _ in edges), Counter(d for _, d in edges)
    got = queries.citation_rank(spark, SF).collect()
    assert len(got) == len(known) and len(edges) > 500
    assert all(abs(r["rank"] - want[r.paper_id]) < 1e-7 and (r.cites, r.cited) == (out[r.paper_id], into[r.paper_id]) for r in got)


def test_a_file_comes_before_an_address(spark, tmp_path):
    (tmp_path / "x.bib").write_text("@article{k, title={T}}")
    (tmp_path / "x.tex").write_text("\\begin{itemize}\n\\item \\textbf{Top}~\\cite{a}\n\\end{itemize}")
    entries = services.load_bibliography(spark, str(tmp_path / "x.bib"), "http://127.0.0.1:9/none")
    assert [(r.key, r.fields["title"]) for r in entries.collect()] == [("k", "T")] == [(r.key, r.fields["title"]) for r in services.load_bibliography(spark, url=f"file://{tmp_path}/x.bib").collect()]
    assert [r.bib_key for r in services.load_categories(spark, url=f"file://{tmp_path}/x.tex").collect()] == ["a"]
    with pytest.raises(ValueError, match="neither"):
        services.load_categories(spark)


def test_limits_of_embedding(spark):
    row = ("T", ["S"], [["x"]], "text")
    chunks = spark.createDataFrame([(f"c{p}{n}", f"p{p}", n, *row) for p in (2, 1) for n in (1, 0)], "chunk_id string, paper_id string, chunk_index int, title string, section_path array<string>, living_review_categories array<array<string>>, text string")
    embedder = embedding.HashingEmbedder(4)
    assert sorted(r.chunk_id for r in embedding.embedding_rows(chunks, embedder, limit=3).collect()) == ["c10", "c11", "c20"]
    with pytest.raises(ValueError, match="no chunks"):
        embedding.embedding_rows(chunks.limit(0), embedder, required=True)
    with pytest.raises(ValueError, match="limit"):
        embedding.embedding_rows(chunks, embedder, limit=0)


def test_sources_lose_all_surrounding_space(spark):
    rows = [(0, 1, "p", "T", False, 1, "a", ["S"], "word \t\x1c\u3000\r\n"), (0, 1, "p", "T", True, None, "c", ["Abstract"], "abs")]
    ranked = spark.createDataFrame(rows, "query_id int, source_number int, paper_id string, title string, is_abstract boolean, position int, chunk_id string, section_path array<string>, text string")
    context = evidence.pack_context(ranked, 500).first().context
    assert context == context.strip() and context.endswith("word")


def test_fusion_ranks_by_exact_sums(spark):
    hits = lambda name, rows: spark.createDataFrame(rows, f"query_id int, chunk_id string, {name} double, rank int")
    far = [(0, "z", 1.0, 1_000_000_000), (0, "a", 1.0, 1_000_000_001)]
    v, x = hits("vector_score", far), hits("lexical_score", [(0, "q", 1.0, 1)])
    assert [r.chunk_id for r in sorted(ranking.fuse(v, x, 3).collect(), key=lambda r: r["rank"])] == ["q", "z", "a"]
    assert [r.chunk_id for r in sorted(ranking.fuse(v, x, 3, digits=12).collect(), key=lambda r: r["rank"])] == ["q", "a", "z"]
